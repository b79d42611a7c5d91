"""Values the rules depend on."""

# Headings that always open a section.
ONTOLOGY = (
    "introduction", "results", "discussion", "conclusion", "conclusions", "experimental section",
    "materials and methods", "acknowledgements", "references", "methods", "abstract",
)
# Beginnings of chunks that are neither heading nor content.
SKIP_STARTS = (
    "keywords:", "graphical abstract", "highlights", "supporting information", "full paper", "table of contents",
    "published online", "doi:", "corrigendum", "received ", "accepted ", "revised ", "available online",
)
# Substrings of banners, links and licences.
JUNK = (
    "http://", "https://", "www.", "@", "doi.org", "doi:", "view article online", "view journal", "view issue",
    "contents lists", "sciencedirect", "homepage", "cite this", "creative commons", "open access",
    "accepted manuscript", "electronic supplementary", "supporting information", "available online", "published on",
    "downloaded on", "licence", "license", "issn", "review article", "research article", "full paper",
)
# Words of journal banners.
JOURNAL_WORDS = (
    "journal", "review", "reviews", "letters", "communications", "proceedings", "advances", "discussions",
    "transactions", "bulletin",
)
# Particles of surnames.
PARTICLES = ("van", "von", "de", "der", "den", "del", "dos", "da", "di", "la", "le", "bin", "al")
# Phrases beside a publication year.
YEAR_ANCHORS = ("©", "(c)", "copyright", "published", "available online", "received", "accepted", "doi.org")
# Beginnings of blocks that end the byline.
BYLINE_STOPS = ("abstract", "keywords", "introduction", "1.")
# Headings of acknowledgments.
ACKNOWLEDGMENTS = ("acknowledgements", "acknowledgments", "funding")
# Caption labels and their canonical kinds.
CAPTION_KINDS = {
    "figure": "Figure", "fig": "Figure", "рис": "Figure", "рисунок": "Figure", "scheme": "Scheme", "схема": "Scheme",
    "table": "Table", "таблица": "Table",
}

# Distances in points, shares, lengths and resolutions of the rules.
MARGIN = 50.0
SPANNING = 0.7
COLUMN_TOLERANCE = 2.0
BLOCK_TOLERANCE = 10.0
SPAN_GAP = 4.0
FONT_STEP = 1.0
SHORTEST_TEXT = 3
DEFAULT_FONT = 12.0
SHORT_TITLE = 12
CAPTION_REACH = 200.0
CONTEXT_SLACK = 10.0
PLACEHOLDER = "\n[FORMULA PLACEHOLDER]\n"
RATIO_THRESHOLD = 0.85
EQUATION_ZOOM = 3.0
CROP_PAD = 5
OCR_DPI = 200
# Fields that a report always has, and the confidence of each source of metadata.
CORE_FIELDS = ("title", "doi", "year", "journal", "authors")
CONFIDENCE = {"crossref": 0.9, "hybrid": 0.6, "pdf": 0.4, "none": 0.2}
