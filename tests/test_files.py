"""Files of every kind: reading, findings, cleaned copies, and bytes that break readers."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vestige.functions import images, manifests, pdf
from vestige.functions.packages import Package, Refused, members, unzipped
from vestige.plans import filepipe
from vestige.sources import files

ZW = "\u200b"


def zipped(parts, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text in {**parts, **more}.items():
            archive.writestr(path, text)
    return out.getvalue()


def chunk(name, body):
    return len(body).to_bytes(4) + name + body + zlib.crc32(name + body).to_bytes(4)


def png(*extra):
    return images.PNG + chunk(b"IHDR", bytes(13)) + b"".join(extra) + chunk(b"IDAT", b"pixels") + chunk(b"IEND", b"")


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body


def jpeg(*extra):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + b"".join(extra) + b"\xff\xda\0\x04ABpixels\xff\xd9"


def box(kind, *payload):
    body = b"".join(payload)
    return (len(body) + 8).to_bytes(4) + kind + body


def labelled(label, *content):
    return box(b"jumb", box(b"jumd", bytes(16), b"\x03", label.encode(), b"\0"), *content)


def text_item(s, major=0x60):
    raw = s.encode()
    return (bytes([major + len(raw)]) if len(raw) < 24 else bytes([major + 24, len(raw)])) + raw


def manifest():
    # an open-ended map, and a text in parts
    claim = b"\xbf" + text_item("claim_generator") + b"\x7f" + text_item("Maker") + text_item("/1") + b"\xff" + text_item("n") + b"\xfa\0\0\0\0" + b"\xff"
    acts = b"\xa1" + text_item("actions") + b"\x81\xa2" + text_item("digitalSourceType") + text_item("http://x/trainedAlgorithmicMedia")
    acts += text_item("softwareAgent") + text_item("Painter")
    return labelled("c2pa", labelled("c2pa.assertions", labelled("c2pa.actions", box(b"cbor", acts))), labelled("c2pa.claim", box(b"cbor", claim)))


CORE = (
    '<cp:coreProperties><dc:creator>Ann &amp; Bo</dc:creator><cp:lastModifiedBy>Unknown</cp:lastModifiedBy><dc:title/>'
    "<dcterms:created>2024-01-01T00:00:00.123Z</dcterms:created><dcterms:modified>2024-01-01T00:00:00.123Z</dcterms:modified></cp:coreProperties>"
)
DOCX = {
    "[Content_Types].xml": '<Types><Override PartName="/docProps/custom.xml" ContentType="c"/><Override PartName="/word/document.xml" ContentType="d"/></Types>',
    "_rels/.rels": '<Relationships><Relationship Id="1" Target="docProps/custom.xml"/><Relationship Id="2" Target="word/document.xml"/></Relationships>',
    "docProps/core.xml": CORE,
    "docProps/app.xml": "<Properties><Application>Office</Application><TotalTime>7</TotalTime><Template>C:\\Users\\ann\\t.dotx</Template></Properties>",
    "docProps/custom.xml": '<Properties><property name="model"><vt:lpwstr>gpt-4o</vt:lpwstr></property></Properties>',
    "word/document.xml": f'<w:p w:author="Cy"><w:t>a{ZW}b &lt;c&gt;</w:t></w:p>',
    "word/settings.xml": '<w:settings><w:rsids><w:rsid w:val="00AB12CD"/></w:rsids></w:settings>',
    "word/_rels/document.xml.rels": '<R><Relationship Target="file:///home/ann/x%20y.doc"/><Relationship Target="bad%"/></R>',
    "word/media/" + "a" * 32 + ".png": png(chunk(b"tEXt", b"k\0v")),
}
ODT = {"mimetype": "application/vnd.oasis.opendocument.text", "meta.xml": '<m><meta:initial-creator>Di</meta:initial-creator><meta:generator/><meta:user-defined meta:name="run">7</meta:user-defined></m>', "content.xml": f"<text:p>x{ZW}</text:p>", "settings.xml": "<s/>"}


def a_pdf(info=b"/Author (Ann) /Producer (P) /CreationDate (D:1) /ModDate (D:1) /Session (s1)"):
    page = zlib.compress(b"BT /F1 9 Tf <0001> Tj (sk-" + b"A" * 40 + b") Tj ET")
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0002> <200B> endbfrange"
    return b"".join(
        [
            b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R /Metadata 6 0 R>> endobj\n2 0 obj <</Kids [3 0 R]>> endobj\n",
            b"3 0 obj <</Type /Page /Contents 4 0 R /Resources <</Font <</F1 <</ToUnicode 5 0 R>> >> >> >> endobj\n",
            b"4 0 obj <</Length %d /Filter /FlateDecode>> stream\n%s\nendstream endobj\n" % (len(page), page),
            b"5 0 obj <</Length 0>> stream\n%s\nendstream endobj\n" % cmap,
            b'6 0 obj <<>> stream\n<x xmp:CreatorTool="Tool"><dc:creator><li>Bo</li></dc:creator></x>\nendstream endobj\n',
            b"7 0 obj <<%s>> endobj\ntrailer <</Root 1 0 R /Info 7 0 R>>" % info,
        ]
    )


def rows_of(spark, contents):
    df = spark.createDataFrame([*contents.items()], "name string, content binary")
    return df.withColumn("hint", files.hint_of(F.col("name")))


def labels(rows):
    return {(r["label"], r["value"]) for r in rows}


def test_texts_are_told_from_bytes(spark):
    cases = {
        b"": None, "é text".encode(): None, b"%PDF-1": "signature: a PDF", b"BZh is how it begins": None, b"BZh\x01": "signature: a bzip2 archive",
        b"a\0b": "nul-bytes", b"\x01" + b"a" * 9: "control-dense", b"\x01" + b"a" * 19: None, b"\xff\xfe": "not-utf8",
    }
    assert {k: files.refusal(k) for k in cases} == cases
    df = rows_of(spark, {"x": b"a\0b", "y": None})
    assert {r.name: r.r for r in df.select("name", files.refused(F.col("content")).alias("r")).collect()} == {"x": "nul-bytes", "y": None}


def test_image_segments_and_chunks():
    camera = segment(0xE1, b"Exif\0\0MM\0*\x88\x25")
    signed = segment(0xEB, b"JP\0\1\0\0\0\1" + manifest())
    whole = jpeg(camera, segment(0xE2, b"ICC"), segment(0xFE, b"note"), signed)
    found = [(r["label"], r["confidence"]) for r in images.image_rows(whole, "here")]
    assert found[:2] == [("Exif with GPS coordinates", "confirmed"), ("Embedded comment", "probable")]
    assert ("C2PA content credentials", "confirmed") in found
    assert images.stripped(whole) == jpeg(segment(0xE2, b"ICC")) and images.stripped(jpeg()) == jpeg()
    picture = png(chunk(b"eXIf", b"x"), chunk(b"tIME", b"t"), chunk(b"caBX", manifest()))
    assert [r["label"] for r in images.image_rows(picture, "p")][:3] == ["Exif camera data", "PNG tIME chunk", "C2PA content credentials"]
    assert images.stripped(picture) == png()
    for cut in range(len(whole)):
        images.image_rows(whole[:cut], "")


def test_manifest_says_who_and_how():
    found = manifests.summary(b"junk" + manifest())
    assert found["generator"] == "Maker/1" and found["software"] == "Painter" and found["assertions"] == ["c2pa.actions", "c2pa.assertions"]
    rows = manifests.manifest_rows(manifest(), "at")
    assert [r["value"].split(" — ")[0] for r in rows[:4]] == ["signed provenance manifest", "Maker/1", "trainedAlgorithmicMedia", "Painter"]
    assert manifests.cbor(b"\x7f\x61a") is None and manifests.cbor(b"\x9f" * 200) is None and manifests.summary(b"none") is None
    assert manifests.manifest_rows(b"", "x", '<a claim_generator="Cam 2"/>')[1]["value"].startswith("Cam 2 — ")


def test_document_package_says_who_made_it():
    found = labels(Package(unzipped(zipped(DOCX))).rows())
    assert {("Author", "Ann & Bo"), ("Total editing time", "7"), ("Custom property: model", "gpt-4o"), ("Comment and revision authors", "Cy")} <= found
    assert ("Link to a local or network path", "file:///home/ann/x y.doc") in found and ("PNG tEXt chunk", "15 bytes") in found
    assert not any(label == "Last modified by" for label, _ in found)
    shape = next(v for k, v in found if k.startswith("Assembled"))
    assert shape.count(";") == 2 and "milliseconds" in shape


def test_cleaned_package_keeps_content():
    package = Package(unzipped(zipped(DOCX)))
    notes = package.redact(lambda t: t.replace(ZW, ""))
    after = Package(unzipped(package.packed()))
    assert notes == [("kept:content", "local links")]
    assert after.bodies() == [("word/document.xml", "ab <c>\n")] and next(iter(after.parts)) == "[Content_Types].xml"
    assert "custom" not in after.text("[Content_Types].xml") + after.text("_rels/.rels") and "word/document.xml" in after.text("_rels/.rels")
    left = {r["label"] for r in after.rows()}
    assert not left & {"Author", "Template", "Custom property: model", "Comment and revision authors", "Revision save IDs", "PNG tEXt chunk"}


def test_open_document():
    package = Package(unzipped(zipped(ODT)))
    found = labels(package.rows())
    assert package.format == "odt" and {("Initial author", "Di"), ("User-defined property: run", "7")} <= found
    assert any(label == "Metadata has been stripped from this file" for label, _ in found)
    package.redact(lambda t: t)
    with zipfile.ZipFile(io.BytesIO(package.packed())) as out:
        first = out.infolist()[0]
        assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED) and out.read("meta.xml") == b"<m></m>"


def test_slides_and_workbooks():
    slides = zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<p:sld show="0"/>', "ppt/slides/slide2.xml": "<p:sld/>", "ppt/notesSlides/notesSlide1.xml": "<a:t>n</a:t>"})
    assert {("Hidden slides", "1 hidden slide still present in the file"), ("Speaker notes", "1 slide with presenter notes")} <= labels(Package(unzipped(slides)).rows())
    book = {"xl/workbook.xml": "<definedName name=\"d\">'C:\\x\\[b.xlsx]S'!$A$1</definedName>", "xl/comments1.xml": "<author>Ed</author><author>Author</author>", "xl/persons/person.xml": '<person displayName="Flo"/>', "xl/externalLinks/externalLink1.xml": "<x/>"}
    found = labels(Package(unzipped(zipped(book))).rows())
    assert ("Comment authors", "Ed, Flo") in found and ("Links to other workbooks", "1 external reference part(s)") in found
    assert any(label == "Defined name pointing outside the workbook" for label, _ in found)


def test_pdf_places():
    found = labels(pdf.Pdf(a_pdf()).rows())
    assert {("Author", "Ann"), ("XMP creator tool", "Tool"), ("XMP author", "Bo"), ("Custom info key: Session", "s1")} <= found
    assert any(k.startswith("Credential") for k, _ in found) and not any("A" * 30 in v for _, v in found)
    assert next(v for k, v in found if k.startswith("Assembled")).startswith("the trailer carries no /ID")
    assert ("page 1", ZW) in [(p, t.split(" ")[0]) for p, t in pdf.Pdf(a_pdf()).bodies()]
    assert pdf.literal(rb"a\(b\)\101\n(c)) rest", 0)[0] == b"a(b)A\n(c)"
    assert pdf.told(b"\xfe\xff\0a") == "a" and pdf.told(b"\0a") == "a" and pdf.told(b"\xe9") == "é"


def test_cleaned_pdf_keeps_its_offsets():
    whole = a_pdf()
    after = pdf.Pdf(whole).redacted()
    assert len(after) == len(whole) and b"Ann" not in after and b"Tool" not in after
    left = {r["label"] for r in pdf.Pdf(after).rows()}
    assert not left & {"Author", "XMP author", "Custom info key: Session"} and pdf.Pdf(after).bodies() == pdf.Pdf(whole).bodies()
    packed = zlib.compress(b"7 0 <</Author (Ann)>>")
    hidden = b"%%PDF-1.5\n1 0 obj <</Type /Catalog>> endobj 9 0 obj <</Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj trailer <</Root 1 0 R /Info 7 0 R>>" % (len(packed), packed)
    assert ("Author", "Ann") in labels(pdf.Pdf(hidden).rows())
    with pytest.raises(Refused):
        pdf.Pdf(hidden).redacted()


def test_archives_are_walked_once_and_guarded():
    inner = zipped({"deep.txt": "x", "folder/": ""})
    found, cut = members(unzipped(zipped({"a.zip": inner, "b.docx": zipped(DOCX), "/home/ann/n.md": "t"})))
    assert [p for p, _ in found] == ["a.zip > deep.txt", "b.docx", "/home/ann/n.md"] and not cut
    found, cut = members({f"{k}.txt": b"" for k in range(2001)})
    assert len(found) == 2000 and cut
    with pytest.raises(Refused):
        unzipped(zipped({str(k): "" for k in range(8193)}))
    with pytest.raises(Refused):
        unzipped(b"PK\x03\x04 cut")


CASES = {
    "a.docx": zipped(DOCX), "b.odt": zipped(ODT), "c.pdf": a_pdf(), "d.png": png(chunk(b"tEXt", b"k\0v")), "e.jpg": jpeg(), "f.txt": f"x{ZW}".encode(),
    "g.md": b"---\nauthor: Ann\n---\n", "h.html": b"<html data-ai-x='1'></html>", "i.bin": b"\0", "j.txt": b"", "k.none": None, "l.zip": zipped({"n.md": f"y{ZW}", "m.pdf": a_pdf(), "o.txt": b"\xff api.openai.com/v1"}),
    "m.pdf": b"%PDF- 1 0 obj " + b"[" * 500, "n.docx": b"PK\x03\x04",
}


def test_inspection_of_every_kind(spark):
    units = filepipe.inspect_files(rows_of(spark, CASES), "name", hint=F.col("hint")).collect()
    first = {r.name: r for r in units if r.unit == 0}
    assert set(first) == set(CASES)
    formats = {n: r.format for n, r in first.items()}
    assert [formats[n] for n in CASES] == ["docx", "odt", "pdf", "png", "jpeg", "text", "markdown", "html", None, "text", None, "zip", None, None]
    assert {n for n, r in first.items() if r.error} == {"i.bin", "k.none", "m.pdf", "n.docx"} and first["i.bin"].error == "nul-bytes"
    assert first["e.jpg"].findings == [] and first["j.txt"].findings == []
    assert [n.code for n in first["l.zip"].notes] == ["scope:archive"]
    places = {f.location for r in units for f in r.findings if r.name == "l.zip"}
    assert "m.pdf → /Info /Author" in places and any(p.startswith("n.md → ") for p in places)
    whole = {(r.name, f.label) for r in units for f in r.findings}
    assert ("a.docx", "Model identifier") in whole and ("l.zip", "LLM provider endpoint") in whole
    assert any(f.location.startswith("word/document.xml (") for r in units if r.name == "a.docx" for f in r.findings)
    assert any(f.location.startswith("page 1 (") for r in units if r.name == "c.pdf" for f in r.findings)


def test_summaries_and_copies(spark):
    df = rows_of(spark, CASES)
    told = {r.name: r for r in filepipe.summarize_files(df, "name", hint=F.col("hint")).collect()}
    assert set(told) == set(CASES) and told["a.docx"].verdict == "attributed" and told["e.jpg"].verdict == "none" and told["i.bin"].error == "nul-bytes"
    copies = filepipe.redact_files(df, "name", hint=F.col("hint"))
    made = {r.name: r for r in copies.collect()}
    assert {n for n, r in made.items() if r.cleaned is None} == {"i.bin", "k.none", "l.zip", "m.pdf", "n.docx"}
    assert made["f.txt"].cleaned == b"x" and made["j.txt"].cleaned == b"" and made["d.png"].cleaned == png()
    again = filepipe.file_findings(copies.where("cleaned is not null"), "name", content="cleaned")
    left = {(r.name, r.label) for r in again.where("conf_rank < 2 and not structural").collect()}
    assert not {x for x in left if x[0] in ("f.txt", "d.png", "h.html", "b.odt")}
    assert filepipe.inspect_files(df.limit(0), "name").count() == 0


def test_walks_pass_by_what_is_not_the_users(spark, tmp_path):
    for name in ("a b.txt", "x/.env", "x/node_modules/m.js", ".git/c.txt", "x/.h/d.txt", "x/e.exe", "mine/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    found = files.read_files(spark, str(tmp_path), skip=["mine"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a b.txt"]
    paths = spark.createDataFrame([("/r/x/.env",), ("/r/.x/a.txt",), ("/r/x",)], "p string")
    assert [r[0] for r in paths.where(files.wanted(F.col("p"), "file:///r")).collect()] == ["/r/x/.env"]
    assert files.read_files(spark, str(tmp_path), walked=False, most=0).where("error = 'too long' and content is null").count() == 4
    df = spark.createDataFrame([("d/a.tar.gz",), ("d.x/a",)], "p string")
    assert [r[0] for r in df.select(filepipe.clean_name(F.col("p"))).collect()] == ["d/a.tar.clean.gz", "d.x/a.clean"]
