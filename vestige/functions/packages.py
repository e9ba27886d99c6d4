"""ZIP packages: guarded reading, the walk of archives, and the metadata of OOXML and ODF."""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

from .fields import (
    APP_FIELDS, ARCHIVES, CORE_FIELDS, CREDENTIALS_PART, NO_NAMES, NOBODY, ODF_FIELDS, ODF_MIME, ODF_NOTHING,
    TELLING_PATH, WALK_BYTES, WALK_DEPTH, WALK_MEMBERS, ZIP_BYTES, ZIP_MEMBERS,
)
from .images import image_rows, stripped
from .manifests import manifest_rows
from .records import Row, content_rows, field_rows, row, source_type_rows

Parts = dict[str, bytes]
LOCAL = re.compile(r"(?i)file:|[a-z]:[\\/]|\\\\")
MAIN_PARTS = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}
ODF_KINDS = {"text": "odt", "spreadsheet": "ods", "presentation": "odp"}
BODY_PARTS = re.compile(r"word/(?:document|footnotes|endnotes|comments|header\d*|footer\d*)\.xml|ppt/(?:slides|notesSlides)/[^/]+\.xml|xl/sharedStrings\.xml")
ODF_BODY = re.compile(r"content\.xml|styles\.xml")
LINE_ENDS = re.compile(r"</w:p>|</a:p>|</text:p>|</text:h>|<w:br[^>]*>|<a:br[^>]*>|<text:line-break[^>]*>")
NOTES = re.compile(r"ppt/notesSlides/notesSlide\d+\.xml")
COMMENTS, PERSONS = re.compile(r"xl/comments\d*\.xml"), re.compile(r"xl/persons/person\d*\.xml")


class Refused(ValueError):
    """A file that isn't read, and why."""


def unzipped(data: bytes) -> Parts:
    """The members of a ZIP file by path. One that declares too much is refused before anything is inflated."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            infos = archive.infolist()
            if len(infos) > ZIP_MEMBERS:
                raise Refused(f"archive declares more than {ZIP_MEMBERS} members")
            if sum(i.file_size for i in infos) > ZIP_BYTES:
                raise Refused(f"archive declares more than {ZIP_BYTES >> 20} MB of uncompressed content")
            return {i.filename: archive.read(i) for i in infos}
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as e:
        raise Refused(f"unreadable archive: {e}") from e


def package_format(parts: Parts) -> str:
    mime = parts.get("mimetype", b"").decode("utf-8", "replace")
    if mime.startswith(ODF_MIME):
        return next((f for kind, f in ODF_KINDS.items() if f"opendocument.{kind}" in mime), "odt")
    return next((f for f, path in MAIN_PARTS.items() if path in parts), "zip")


def members(parts: Parts) -> tuple[list[tuple[str, bytes]], bool]:
    """(path, bytes) of files in an archive and in archives inside it, and whether a bound cut the list.

    Each member comes once; one that is an archive comes only as its members.
    """
    out: list[tuple[str, bytes]] = []
    spent = 0

    def walk(level: Parts, prefix: str, depth: int) -> bool:
        nonlocal spent
        for name, data in level.items():
            if name.endswith("/"):
                continue
            spent += len(data)
            if len(out) >= WALK_MEMBERS or spent > WALK_BYTES:
                return False
            if depth < WALK_DEPTH and re.search(ARCHIVES, name):
                try:
                    inner = unzipped(data)
                except Refused:
                    inner = None
                if inner is not None and package_format(inner) == "zip":
                    if not walk(inner, f"{prefix}{name} > ", depth + 1):
                        return False
                    continue
            out.append((prefix + name, data))
        return True

    return out, not walk(parts, "", 0)


def path_rows(paths: list[str]) -> list[Row]:
    told = [p for p in paths if re.search(TELLING_PATH, p)]
    return [row("environment", "probable", "archive member paths", "Absolute paths preserved in the archive", ", ".join(told[:3]))] if told else []


def decoded(text: str) -> str:
    return html.unescape(re.sub(r"&(?!(?:lt|gt|amp|quot|apos|#\d+|#[xX][0-9A-Fa-f]+);)", "&amp;", text))


def element(xml: str, tag: str) -> str | None:
    """Text of the first such element; '' if it is empty, None if there is none."""
    m = re.search(rf"<{re.escape(tag)}(?=[\s/>])[^>]*?(?:/>|>(.*?)</{re.escape(tag)}>)", xml, re.DOTALL)
    return None if m is None else decoded(re.sub(r"<[^>]*>", "", m[1] or "")).strip()


def attributes(xml: str, name: str) -> list[str]:
    found = re.findall(rf"\s{re.escape(name)}=\"([^\"]*)\"", xml)
    return [x for x in dict.fromkeys(map(decoded, found)) if x]


def properties(xml: str, tag: str, name: str) -> list[tuple[str, str]]:
    """(name, value) of the elements that hold a value under a name."""
    found = re.findall(rf"<{re.escape(tag)}(?=\s)([^>]*)>(.*?)</{re.escape(tag)}>", xml, re.DOTALL)
    named = ((attributes(" " + head, name), decoded(re.sub(r"<[^>]*>", "", body)).strip()) for head, body in found)
    return [(names[0], value) for names, value in named if names and value]


def visible(xml: str) -> str:
    return decoded(re.sub(r"<[^>]*>", "", LINE_ENDS.sub("\n", xml)))


class Package:
    """Parts of a document, as text where asked."""

    def __init__(self, parts: Parts):
        self.parts, self.format = parts, package_format(parts)
        self.odf = self.format in ODF_KINDS.values()
        self.body = ODF_BODY if self.odf else BODY_PARTS
        self.media = re.compile(r"Pictures/" if self.odf else r"(?:ppt|word|xl)/media/")

    def text(self, path: str) -> str | None:
        return self.parts[path].decode("utf-8", "replace") if path in self.parts else None

    def texts(self, pattern: str | re.Pattern) -> Iterator[tuple[str, str]]:
        yield from ((p, self.text(p)) for p in self.parts if re.search(pattern, p))

    def bodies(self) -> list[tuple[str, str]]:
        """(path, visible text) of the parts that a reader sees."""
        return [(p, visible(self.text(p))) for p in self.parts if self.body.fullmatch(p)]

    def hidden_slides(self) -> list[str]:
        shown = r"<p:sld(?=\s)[^>]*\sshow=\"(?:0|false)\""
        return sorted(p for p, xml in self.texts(r"^ppt/slides/[^/]+\.xml$") if re.search(shown, xml))

    def noted_slides(self) -> int:
        return sum(bool(NOTES.fullmatch(p) and re.search("<a:t>[^<]+</a:t>", xml)) for p, xml in self.texts("^ppt/notesSlides/"))

    def local_links(self) -> list[tuple[str, str]]:
        found = ((p, unquote(t)) for p, xml in self.texts(r"\.rels$") for t in attributes(xml, "Target"))
        return [(p, t) for p, t in found if LOCAL.match(t)]

    def outside_names(self) -> list[str]:
        found = re.findall(r"<definedName[^>]*name=\"([^\"]+)\"[^>]*>([^<]*)<", self.text("xl/workbook.xml") or "")
        return [f"{name} → {value}" for name, value in found if LOCAL.match(value.removeprefix("'"))]

    def linked_books(self) -> list[str]:
        return [p for p in self.parts if p.startswith("xl/externalLinks/")]

    def rows(self) -> list[Row]:
        """Everything but the characters of the body."""
        own = [*self.odf_rows()] if self.odf else [*self.office_rows()]
        pictures = [r for p, d in self.parts.items() if self.media.match(p) for r in image_rows(d, p)]
        signed = [r for p, d in self.parts.items() if re.search(CREDENTIALS_PART, p) for r in manifest_rows(d, p)]
        scanned = [
            r for p, text in self.texts(r"\.(xml|rdf|txt|json)$" if self.odf else r"\.(xml|rels|json|txt|bin)$")
            for r in (*content_rows(text, p), *source_type_rows(text, p))
        ]
        return [*own, *pictures, *signed, *scanned, *(self.odf_shape() if self.odf else self.office_shape())]

    def office_rows(self) -> Iterator[Row]:
        core, app, custom = (self.text(f"docProps/{x}.xml") for x in ("core", "app", "custom"))
        if core is not None:
            yield from field_rows(CORE_FIELDS, lambda tag: element(core, tag), "docProps/core.xml:", NO_NAMES)
        if app is not None:
            yield from field_rows(APP_FIELDS, lambda tag: element(app, tag), "docProps/app.xml:", ["0"])
        if custom is not None:
            told = properties(custom, "property", "name")
            for name, value in told:
                yield row("identity", "confirmed", f"docProps/custom.xml:{name}", f"Custom property: {name}", value)
            if not told:
                names = attributes(custom, "name")
                value = ", ".join(names) or "the part exists but holds no properties"
                yield row("identity", "confirmed" if names else "informational", "docProps/custom.xml", "Custom properties", value)
        stores = [p for p in self.parts if p.startswith("customXml/")]
        if stores:
            n = sum(bool(re.search(r"customXml/item\d*\.xml$", p)) for p in stores) or len(stores)
            yield row("identity", "probable", "customXml/", "Custom XML data store", f"{n} part(s) — content-control bindings, library columns or classification labels")
        thumbnail = next((p for p in self.parts if p.startswith("docProps/thumbnail")), None)
        if thumbnail:
            yield row("identity", "probable", thumbnail, "Embedded thumbnail", "rendered preview of document content")
        saves = [v for v in attributes(self.text("word/settings.xml") or "", "w:val") if re.fullmatch("[0-9A-Fa-f]{8}", v)]
        if saves:
            value = f"{len(saves)} value{'s' * (len(saves) > 1)} (correlate documents edited in the same session)"
            yield row("environment", "probable", "word/settings.xml:w:rsid", "Revision save IDs", value)
        people = dict.fromkeys(a for p, xml in self.texts(r"(comments|people|document|slide).*\.xml$") for a in attributes(xml, "w:author"))
        people.pop(NOBODY, None)
        if people:
            yield row("identity", "confirmed", "tracked changes / comments", "Comment and revision authors", ", ".join(people))
        for path, target in self.local_links():
            yield row("environment", "confirmed", path, "Link to a local or network path", target)
        hidden, notes = self.hidden_slides(), self.noted_slides()
        if hidden:
            value = f"{len(hidden)} hidden slide{'s' * (len(hidden) > 1)} still present in the file"
            yield row("identity", "probable", ", ".join(hidden), "Hidden slides", value)
        if notes:
            yield row("identity", "probable", "ppt/notesSlides/", "Speaker notes", f"{notes} slide{'s' * (notes > 1)} with presenter notes")
        yield from self.book_rows()

    def book_rows(self) -> Iterator[Row]:
        named = [decoded(a).strip() for p, xml in self.texts("^xl/comments") if COMMENTS.fullmatch(p) for a in re.findall("<author>([^<]+)</author>", xml)]
        named += [a for p, xml in self.texts("^xl/persons/") if PERSONS.fullmatch(p) for a in attributes(xml, "displayName")]
        people = [a for a in dict.fromkeys(named) if a and a != NOBODY]
        if people:
            yield row("identity", "confirmed", "xl/comments, xl/persons", "Comment authors", ", ".join(people))
        outside, linked = self.outside_names(), self.linked_books()
        if outside:
            yield row("environment", "confirmed", "xl/workbook.xml:definedName", "Defined name pointing outside the workbook", "; ".join(outside))
        if linked:
            n = sum(p.endswith(".xml") for p in linked)
            yield row("environment", "probable", "xl/externalLinks/", "Links to other workbooks", f"{n} external reference part(s)")

    def office_shape(self) -> Iterator[Row]:
        core, app, settings = self.text("docProps/core.xml") or "", self.text("docProps/app.xml") or "", self.text("word/settings.xml") or ""
        if "Un-named" in (element(core, "dc:creator"), element(core, "cp:lastModifiedBy")):
            value = (
                'docx (JavaScript library) — "Un-named" is that library\'s default for the author fields, verified in its source. '
                "Many products embed it, so this names what wrote the file and not who asked for it"
            )
            yield row("provenance", "confirmed", "docProps/core.xml", "Written by the docx JavaScript library", value)
        created, modified = element(core, "dcterms:created"), element(core, "dcterms:modified")
        hashed = sum(bool(self.media.match(p) and re.search(r"(?i)/[0-9a-f]{32,64}\.[a-z0-9]+$", p)) for p in self.parts)
        signs = {
            "docProps/app.xml is present but empty": re.search(r"<Properties[^>]*?(?:/>|>\s*</Properties>)", app),
            "timestamps carry milliseconds, the shape JavaScript writes": created and re.search(r"\.\d{3}Z$", created),
            "created and modified are the same instant": created and created == modified,
            "no revision save IDs, which Word always writes": self.format == "docx" and settings and "rsid" not in settings.lower(),
            f"{hashed} media file(s) named by content hash rather than image1, image2": hashed,
        }
        reasons = [text for text, holds in signs.items() if holds]
        if len(reasons) > 1:
            level = "confirmed" if len(reasons) > 2 else "probable"
            yield row("provenance", level, "container structure", "Assembled by a program, not typed in a word processor", "; ".join(reasons))

    def odf_rows(self) -> Iterator[Row]:
        meta = self.text("meta.xml")
        if meta is not None:
            yield from field_rows(ODF_FIELDS, lambda tag: element(meta, tag), "meta.xml:", ODF_NOTHING)
            told = properties(meta, "meta:user-defined", "meta:name")
            for name, value in told:
                yield row("identity", "confirmed", f"meta.xml:meta:user-defined:{name}", f"User-defined property: {name}", value)
            names = [] if told else attributes(meta, "meta:name")
            if names:
                yield row("identity", "confirmed", "meta.xml:meta:user-defined", "User-defined properties", ", ".join(names))
        if any(p.startswith("Thumbnails/") for p in self.parts):
            yield row("identity", "probable", "Thumbnails/", "Embedded thumbnail", "rendered preview of document content")

    def odf_shape(self) -> Iterator[Row]:
        meta = self.text("meta.xml") or ""
        generator, created = element(meta, "meta:generator"), element(meta, "meta:creation-date")
        settings = "settings.xml" in self.parts
        if settings and generator == "":
            value = (
                "the generator element is present and empty, which no application writes; the package still carries the parts "
                "an office suite adds, so the metadata was removed after the fact"
            )
            yield row("provenance", "confirmed", "meta.xml:meta:generator", "Metadata has been stripped from this file", value)
        strong = [] if settings else ["no settings.xml, which records the state of an open window"]
        if meta and not element(meta, "meta:editing-cycles"):
            strong.append("no edit-cycle count, which an office suite writes on the first save")
        weak = [] if any(p.startswith("Thumbnails/") for p in self.parts) else ["no embedded thumbnail"]
        weak += [] if "manifest.rdf" in self.parts else ["no manifest.rdf"]
        if strong and len(strong) + len(weak) > 1:
            claim = f" — despite meta:generator naming {generator}" if generator else ""
            level = "probable" if len(strong) > 1 else "informational"
            yield row("provenance", level, "package structure", "Assembled by a program, not saved from an office suite", "; ".join(strong + weak) + claim)
        if created and created == element(meta, "dc:date"):
            value = "created and last modified at the same instant, so the file was never reopened"
            yield row("provenance", "informational", "meta.xml", "Written in a single pass", value)

    # cleaning

    def rewrite(self, path: str, *steps: tuple[str, str]) -> None:
        if path in self.parts:
            xml = self.text(path)
            for pattern, new in steps:
                xml = re.sub(pattern, new, xml, flags=re.DOTALL)
            self.parts[path] = xml.encode()

    def drop(self, path: str) -> None:
        """The part goes, and what declares or points at it."""
        del self.parts[path]
        quoted = re.escape(path)
        self.rewrite("[Content_Types].xml", (rf"<Override[^>]*PartName=\"/{quoted}\"[^>]*?(?:/>|></Override>)", ""))
        for rels in [p for p in self.parts if p.endswith(".rels")]:
            owner = rels.split("_rels/")[0]

            def kept(m: re.Match, owner=owner) -> str:
                target = re.search(r"Target=\"([^\"]*)\"", m[0])
                return "" if target and resolved(owner, decoded(target[1])) == path else m[0]

            self.parts[rels] = re.sub(r"<Relationship\s[^>]*?(?:/>|></Relationship>)", kept, self.text(rels)).encode()

    def redact(self, clean) -> list[tuple[str, str]]:
        """Take metadata out of the parts; clean() takes carriers out of a text. Gives notes, (code, detail)."""
        notes = [("removed:c2pa", p) for p in self.parts if re.search(CREDENTIALS_PART, p)]
        if self.odf:
            gone = [p for p in self.parts if p.startswith("Thumbnails/") or re.search(CREDENTIALS_PART, p)]
            tags = [f[0] for f in ODF_FIELDS] + ["meta:user-defined", "meta:document-statistic"]
            self.rewrite("meta.xml", *((removal(t), "") for t in tags))
        else:
            gone = [p for p in self.parts if p == "docProps/custom.xml" or p.startswith(("customXml/", "docProps/thumbnail")) or re.search(CREDENTIALS_PART, p)]
            dates = ["dcterms:created", "dcterms:modified"]
            self.rewrite("docProps/core.xml", *((removal(t), "") if t in dates else blanking(t, "") for t, *_ in CORE_FIELDS))
            self.rewrite("docProps/app.xml", *(blanking(t, "0" if t == "TotalTime" else "") for t, *_ in APP_FIELDS))
            self.rewrite("word/settings.xml", (removal("w:rsids"), ""), (r"\sw:rsid(?:R|RDefault)=\"[^\"]*\"", ""))
            for path in [p for p in self.parts if p.endswith(".xml")]:
                self.rewrite(path, (r"\sw:author=\"[^\"]*\"", f' w:author="{NOBODY}"'))
                if COMMENTS.fullmatch(path):
                    self.rewrite(path, ("<author>[^<]*</author>", f"<author>{NOBODY}</author>"))
                if PERSONS.fullmatch(path):
                    self.rewrite(path, (r"\sdisplayName=\"[^\"]*\"", f' displayName="{NOBODY}"'))
        for path in gone:
            self.drop(path)
        for path in self.parts:
            if self.body.fullmatch(path):
                # what isn't a carrier stays as it was written, references too
                self.parts[path] = re.sub(r">[^<]+<", lambda m: clean(m[0]), self.text(path)).encode()
            elif self.media.match(path):
                self.parts[path] = stripped(self.parts[path])
        left = {
            "local links": self.local_links(), "hidden slides": self.hidden_slides(), "speaker notes": self.noted_slides(),
            "external workbook references": self.outside_names() or self.linked_books(),
        }
        kept = ", ".join(name for name, found in left.items() if found)
        return [*notes, *([("kept:content", kept)] if kept else [])]

    def packed(self) -> bytes:
        """The package, with the part first that its format wants first; equal parts give equal bytes."""
        first = "mimetype" if self.odf else "[Content_Types].xml"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for path in sorted(self.parts, key=lambda p: p != first):
                stored = self.odf and path == first
                info = zipfile.ZipInfo(path)
                info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
                archive.writestr(info, self.parts[path], compresslevel=None if stored else 6)
        return out.getvalue()


def removal(tag: str) -> str:
    t = re.escape(tag)
    return rf"<{t}(?=[\s/>])[^>]*?(?:/>|>.*?</{t}>)"


def blanking(tag: str, new: str) -> tuple[str, str]:
    t = re.escape(tag)
    return rf"(<{t}(?=[\s>])[^>]*(?<!/)>).*?(</{t}>)", rf"\g<1>{new}\g<2>"


def resolved(owner: str, target: str) -> str:
    """The path of a relationship's target, relative to the folder of its owner."""
    if target.startswith("/"):
        return target[1:]
    steps: list[str] = []
    for step in (owner + target).split("/"):
        if step == "..":
            steps = steps[:-1]
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps)
