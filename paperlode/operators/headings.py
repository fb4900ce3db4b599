"""Fixed values of the Markdown cleaner: the words, numbers and patterns by which headings and paragraphs are told apart."""

import re

# Fixed values. Keys are lower-case words joined by single blanks.
STOPWORDS = (
    "about", "after", "against", "among", "because", "between", "could", "first", "found", "from", "have", "into",
    "journal", "paper", "results", "study", "their", "these", "using", "with",
)
DROPPED = {
    "article info", "articleinfo", "article history", "articlehistory", "keywords", "keyword", "graphical abstract",
    "graphicalabstract", "abbreviations", "just accepted", "accepted article", "accepted manuscript",
    "author s accepted manuscript", "authors accepted manuscript", "manuscript version accepted manuscript",
    "affiliations", "affiliation", "articles you may be interested in", "reuse", "takedown",
}
SUMMARY = {"statement of significance", "statementofsignificance", "highlights", "highlight"}
TAIL = {
    "references", "bibliography", "acknowledgements", "acknowledgments", "funding", "funding statement",
    "fundingstatement", "author contributions", "authorcontributions", "credit authorship contribution statement",
    "creditauthorshipcontributionstatement", "conflict of interest", "conflicts of interest", "conflictsofinterest",
    "declaration of interest", "declaration of interests", "declaration of competing interest",
    "declaration of competing interests", "declarationofinterest", "declarationofinterests",
    "declarationofcompetinginterest", "declarationofcompetinginterests", "supplementary information",
    "supplementary material", "supplementary materials", "supplementaryinformation", "supplementarymaterial",
    "supplementarymaterials", "appendix",
}
SECTIONS = {
    "abstract", "introduction", "background", "methods", "materials and methods", "methods and materials",
    "experimental", "materials", "results", "results and discussion", "discussion", "conclusion", "conclusions",
    "outlook", "limitations", "statistical analysis",
}
INLINE_SUMMARY = ("statement of significance:", "highlights:")
NOT_TITLES = {
    "research article", "article open", "communication", "full length article", "review article", "review",
    "original article", "original research", "research", "article", "perspective", "just accepted", "accepted article",
    "accepted manuscript", "author s accepted manuscript", "authors accepted manuscript",
    "manuscript version accepted manuscript", "short communication", "rapid communication", "letter", "letters",
    "reuse", "takedown", "method article", "corresponding author", "corresponding authors", "regular article",
}
PAGE_HEADINGS = {
    "view article online", "view journal", "view issue", "view journal view issue", "check for updates",
    "international edition", "view online", "export citation",
}
MASTHEADS = {
    "nanoscale", "chemcomm", "crystengcomm", "journal of materials chemistry b", "soft matter",
    "a journal of the gesellschaft deutscher chemiker angewandte gdch international edition chemie",
}
MASTHEAD_WORDS = {"nature", "science", "cell", "small"}
RESETS = {
    "article", "just accepted", "accepted article", "accepted manuscript", "author s accepted manuscript",
    "authors accepted manuscript", "manuscript version accepted manuscript", "reuse", "takedown",
}
METADATA = (
    "just accepted manuscript", "accepted article", "this is an accepted manuscript",
    "accepted manuscripts are published online shortly after acceptance",
    "you can find more information about accepted manuscripts", "author guidelines", "information for authors",
    "can be cited before page numbers have been issued", "peer review process", "replace this accepted manuscript",
    "this document is the unedited author's version", "final edited and published work",
    "downloaded from http://pubs.acs.org", "downloaded from https://pubs.acs.org", "available online",
    "published online", "corresponding author", "deposited via the university of", "white rose research online",
    "accepted version", "withdrawal request", "view supplementary material", "submit your article to this journal",
    "view related articles", "view crossmark data", "supplementary information", "supplementary material",
    "conflict of interest", "declaration of competing interest", "data availability", "orcid", "doi:",
    "creativecommons", "open access article", "published by", "published under", "exclusive license",
    "all rights reserved", "angewandte.org", "gesellschaft deutscher chemiker",
)
METADATA_START = re.compile(
    r"\s*(?:(?:title|authors?)\s*[:：]|to\s+(?:cite|link)\s+to\s+this\s+article\s*[:：]|version\s*:\s*accepted version\b"
    r"|deposited via\b|article\s+views\s*[:：]|(?:received|accepted)\b|(?:cite\s+as|cite\s+this)\s*[:：])",
    re.IGNORECASE,
)
LINK = re.compile(r"(?:https?://|www\.|rsc\.li/)\S+", re.IGNORECASE)
NEAR_MASTHEAD = (
    "accepted manuscript", "accepted version", "royal society of chemistry", "can be cited before page numbers",
    "information for authors", "author guidelines", "white rose research online",
)
PLACES = ("university", "department", "school", "institute", "laboratory", "faculty", "academy", "campus", "hospital", "college", "centre", "center")
COUNTRIES = ("germany", "france", "china", "israel", "sweden", "denmark", "japan", "italy", "spain", "usa", "united kingdom", "uk")
NOT_NAMES = ("university", "department", "institute", "school", "hospital")
HONORIFICS = ("prof.", "dr.", "mr.", "mrs.", "ms.")
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
IMAGE = re.compile(r"^!\[[^\]]*\]\([^)]+\)\s*$")
EMAIL = re.compile(r"[\w.\-+]+@[\w.\-]+\.\w+")
NUMBERING = re.compile(r"^\s*(?:\d+(?:\.\d+)*[.)]?\s+|[ivxlcdm]+\.?\s+)", re.IGNORECASE)
CONFERENCE = re.compile(r"^[A-Z]{1,4}\d{2,5}[A-Z]?$")
CAPTION = re.compile(r"^(fig(?:ure)?|scheme|table)\b", re.IGNORECASE)
CAPTION_GOES_ON = re.compile(r"^(?:\(?[a-z]\)?[,.:]|\([a-z]\)|left\b|right\b|top\b|bottom\b)")
CAPTION_WORDS = ("scale bar", "inset", "arrowhead")
LABEL = re.compile(r"(?:page\s+)?\d+|\(?[a-z]\)?\s*(?:[.,]|-\s*\d+\s*hrs?)?")
FIGURE_NUMBER = re.compile(r"(?:fig(?:ure)?\.?\s*)?\d+[a-z]?[.]?", re.IGNORECASE)
TABLE_TAGS = ("<tr", "</tr", "<td", "</td", "<th", "</th")
SENTENCE_END = re.compile(r"[.!?;:](?:[\"')\]]|\s)*$")
SENTENCE_CUT = re.compile(r"(?<=[.!?])(?:[\"')\]]+)?\s+")
#: Title points: before and after the first section, for each word up to eight, for each thirty characters up to four, for
#: lower-case letters, for a masthead; the least of a title, and by how much it must lead.
BEFORE, AFTER, WORDS, LENGTHS, LOWER, MASTHEAD, LEAST, LEAD = 4, -6, 8, 4, 2, -8, 5, 2
#: Words or characters of a substantial paragraph; shares of the chunk size (and floors) of a small, a target and a full chunk.
PROSE_WORDS, PROSE_CHARS = 35, 240
SMALL, TARGET, FULL = (300, 0.41), (400, 0.68), (800, 1.0)
# End of the fixed values.
