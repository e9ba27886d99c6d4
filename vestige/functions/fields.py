"""Fixed values of files: signatures, names, and the fields in which formats keep metadata."""

# Signatures of what is no text (bytes, name).
SIGNATURES = [
    (b"PK\x03\x04", "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB)"),
    (b"PK\x05\x06", "an empty ZIP container"),
    (b"PK\x07\x08", "a spanned ZIP container"),
    (b"%PDF-", "a PDF"),
    (b"\x89PNG\r\n\x1a\n", "a PNG image"),
    (b"\xff\xd8\xff", "a JPEG image"),
    (b"GIF87a", "a GIF image"),
    (b"GIF89a", "a GIF image"),
    (b"II*\x00", "a TIFF image"),
    (b"MM\x00*", "a TIFF image"),
    (b"\x1f\x8b", "a gzip archive"),
    (b"\xfd7zXZ\x00", "an xz archive"),
    (b"7z\xbc\xaf\x27\x1c", "a 7-Zip archive"),
    (b"Rar!\x1a\x07", "a RAR archive"),
    (b"\x7fELF", "an ELF binary"),
    (b"\xca\xfe\xba\xbe", "a Java class or Mach-O binary"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a legacy Office document (.doc, .xls, .ppt)"),
    (b"SQLite format 3\x00", "a SQLite database"),
]
# Signatures that a text may begin with, so that a control byte must follow early.
DOUBTFUL_SIGNATURES = [
    (b"RIFF", "a RIFF container (WEBP, WAV, AVI)"),
    (b"OggS", "an Ogg media file"),
    (b"BZh", "a bzip2 archive"),
    (b"8BPS", "a Photoshop document"),
    (b"wOFF", "a WOFF font"),
    (b"wOF2", "a WOFF2 font"),
    (b"OTTO", "an OpenType font"),
]
# Bounds.
SNIFFED, CONTROL_SHARE, EARLY = 8192, 0.05, 32
ALLOWED_CONTROLS = b"\x09\x0a\x0b\x0c\x0d\x1b"
ZIP_MEMBERS, ZIP_BYTES = 8192, 512 * 1024 * 1024
WALK_MEMBERS, WALK_BYTES, WALK_DEPTH = 2000, 256 * 1024 * 1024, 3
PDF_BYTES = 8 * 1024 * 1024
CMAP_ENTRIES = 65536

# What a walk of folders takes and passes by.
EXTENSIONS = (
    "pdf pptx docx xlsx odt ods odp svg html htm md markdown mdx jpg jpeg png zip epub txt text log csv tsv eml mbox json yaml yml toml ini "
    "js mjs cjs ts tsx jsx py rb rs go java kt swift c h cpp hpp cs php sh sql css scss xml rst adoc"
).split()
SECRET_FILES = [".env", ".env.local", ".env.production", ".npmrc", ".netrc"]
PASSED_FOLDERS = (
    ".git .hg .svn node_modules bower_components vendor __pycache__ .venv venv .tox .mypy_cache .pytest_cache .ruff_cache "
    "dist build out target .next .nuxt .svelte-kit .cache .gradle .terraform coverage .idea .vscode"
).split()
ARCHIVES = r"(?i)\.(zip|jar|epub)$"
TEXTUAL = (
    r"(?i)\.(txt|md|markdown|json|ya?ml|toml|ini|cfg|conf|env|xml|html?|css|js|mjs|cjs|ts|tsx|jsx|py|rb|go|rs|java|kt|sh|bash|zsh|ps1|sql|csv|log|srt|vtt)$"
    r"|(^|/)\.env|(^|/)dockerfile$"
)
TELLING_PATH = r"Users[\\/]|/home/|AppData|/var/folders/"

# Fixed values: (element or key, label, kind, confidence).
CORE_FIELDS = [
    ("dc:creator", "Author", "identity", "confirmed"),
    ("cp:lastModifiedBy", "Last modified by", "identity", "confirmed"),
    ("dc:title", "Title", "identity", "probable"),
    ("dc:subject", "Subject", "identity", "probable"),
    ("dc:description", "Description", "identity", "probable"),
    ("cp:keywords", "Keywords", "identity", "probable"),
    ("cp:category", "Category", "identity", "probable"),
    ("cp:contentStatus", "Content status", "identity", "informational"),
    ("cp:revision", "Revision number", "timestamp", "probable"),
    ("cp:lastPrinted", "Last printed", "timestamp", "probable"),
    ("dcterms:created", "Created", "timestamp", "probable"),
    ("dcterms:modified", "Modified", "timestamp", "probable"),
]
APP_FIELDS = [
    ("Application", "Producing application", "provenance", "informational"),
    ("AppVersion", "Application version", "provenance", "informational"),
    ("Company", "Company", "identity", "confirmed"),
    ("Manager", "Manager", "identity", "confirmed"),
    ("Template", "Template", "environment", "confirmed"),
    ("TotalTime", "Total editing time", "timestamp", "probable"),
]
ODF_FIELDS = [
    ("meta:initial-creator", "Initial author", "identity", "confirmed"),
    ("dc:creator", "Last modified by", "identity", "confirmed"),
    ("meta:printed-by", "Printed by", "identity", "confirmed"),
    ("dc:title", "Title", "identity", "probable"),
    ("dc:subject", "Subject", "identity", "probable"),
    ("dc:description", "Description", "identity", "probable"),
    ("meta:keyword", "Keywords", "identity", "probable"),
    ("meta:generator", "Producing application", "provenance", "informational"),
    ("meta:creation-date", "Created", "timestamp", "probable"),
    ("dc:date", "Modified", "timestamp", "probable"),
    ("meta:print-date", "Last printed", "timestamp", "probable"),
    ("meta:editing-cycles", "Edit cycles", "timestamp", "probable"),
    ("meta:editing-duration", "Total editing time", "timestamp", "probable"),
]
INFO_FIELDS = [
    ("Title", "Title", "identity", "probable"),
    ("Author", "Author", "identity", "confirmed"),
    ("Subject", "Subject", "identity", "probable"),
    ("Keywords", "Keywords", "identity", "probable"),
    ("Creator", "Creating application", "provenance", "informational"),
    ("Producer", "Producing application", "provenance", "informational"),
    ("CreationDate", "Created", "timestamp", "probable"),
    ("ModDate", "Modified", "timestamp", "probable"),
]
XMP_FIELDS = [
    ("xmp:CreatorTool", "XMP creator tool", "provenance", "informational"),
    ("pdf:Producer", "XMP producer", "provenance", "informational"),
    ("dc:creator", "XMP author", "identity", "confirmed"),
    ("dc:title", "XMP title", "identity", "probable"),
    ("xmp:CreateDate", "XMP created", "timestamp", "probable"),
    ("xmp:ModifyDate", "XMP modified", "timestamp", "probable"),
    ("xmpMM:DocumentID", "XMP document ID", "environment", "probable"),
    ("xmpMM:InstanceID", "XMP instance ID", "environment", "probable"),
]
NO_NAMES = ["Un-named", "Unknown", "unknown", "Anonymous", "Author"]
NOBODY = "Author"
ODF_NOTHING = ["0", "PT00H00M00S"]
ODF_MIME = "application/vnd.oasis.opendocument"
CREDENTIALS_PART = r"(?i)c2pa|contentcredentials|content_credentials"
UNSIGNED = "asserted by the manifest, signature not verified"
