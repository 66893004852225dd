"""Word lists that mention extraction and answer rules depend on."""

PREFIX_TRIM = ["introduction"]
CONNECTORS = ["a", "an", "the", "of", "for", "and", "or", "to", "by", "from", "as", "in", "on", "at", "de", "la", "von", "van", "&"]
INNER_CONNECTORS = ["of", "for", "and", "the", "&", "in", "on", "at", "de", "la", "von", "van"]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
SINGLE_DROPS = [
    "introduction", "currently", "former", "present", "references", "external", "links", "see", "also",
    "it", "he", "she", "they", "we", "i", "you", "his", "her", "their", "its", "this", "that", "these", "those",
    "ceo", "cfo", "coo", "cto", "professor", "officer",
    "center", "centre", "science", "law", "medicine", "department", "school",
    *MONTHS,
]
ACRONYM_DROPS = ["CEO", "CFO", "COO", "CTO"]
DEMONYMS = [
    "american", "german", "french", "british", "chinese", "japanese", "korean", "italian", "spanish", "russian", "indian",
    "canadian", "australian",
]
ROLE_PREFIXES = ["professor of", "chief ", "co-founder", "founder", "officer"]
PRONOUNS = ["he", "she", "they", "it", "him", "her", "them", "his", "their", "its", "this", "that", "these", "those"]
LINKED_PRONOUNS = ["he", "she", "they", "it", "him", "her", "them", "his", "their", "its"]
DETERMINERS = ["a", "an", "the", "my", "your", "our"]
TITLE_STOPWORDS = CONNECTORS
US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania",
    "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming",
]
COUNTRIES = [
    "united states", "usa", "u.s.", "united kingdom", "uk", "england", "scotland", "wales", "northern ireland", "canada",
    "mexico", "china", "germany", "france", "spain", "italy", "poland",
]
