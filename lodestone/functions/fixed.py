"""Fixed values of the domain: names, weights and patterns that results depend on."""

#: alias -> county, in order of precedence
COUNTIES = {
    "marion": "Marion County", "hamilton": "Hamilton County", "hendricks": "Hendricks County", "johnson": "Johnson County", "boone": "Boone County",
    "allen": "Allen County", "vanderburgh": "Vanderburgh County", "tippecanoe": "Tippecanoe County", "lake": "Lake County", "monroe": "Monroe County",
}
STATE, STATE_SIGNS = "Indiana", ("indiana", " ind ", "in court")

#: keyword -> case type, in order of precedence
CASE_TYPES = {
    "criminal": "Criminal", "felony": "Criminal", "misdemeanor": "Criminal", "civil": "Civil", "small claims": "Small Claims", "family": "Family",
    "juvenile": "Juvenile", "estate": "Probate", "probate": "Probate", "contract": "Civil", "tort": "Civil",
}

CURRENT_SIGNS = ("current", "current law", "currently", "now", "today", "still valid", "still in effect", "still applies", "effective", "in force")

STOPWORDS = ("the", "a", "an", "is", "in", "of", "for", "on", "at", "to", "and", "or", "what", "how", "when", "where", "who", "does", "did", "can", "will", "my", "i", "me")

#: court name -> authority
COURT_WEIGHTS = {
    "us supreme court": 1.00, "supreme court of the united states": 1.00, "scotus": 1.00,
    "7th circuit court of appeals": 0.90, "united states court of appeals for the seventh circuit": 0.90, "ca7": 0.90,
    "indiana supreme court": 0.85, "supreme court of indiana": 0.85, "ind": 0.85,
    "indiana court of appeals": 0.70, "court of appeals of indiana": 0.70, "indctapp": 0.70,
    "indiana tax court": 0.60, "indtc": 0.60,
    "united states district court for the southern district of indiana": 0.55, "united states district court for the northern district of indiana": 0.55, "s.d. ind": 0.55, "n.d. ind": 0.55,
    "marion county superior court": 0.40,
}
COURT_DEFAULT = 0.35

NEGATIVE_TREATMENTS = ("overruled", "overruled by", "reversed", "disapproved", "abrogated", "criticized", "distinguished")
POSITIVE_TREATMENTS = ("affirmed", "followed", "cited", "relied on", "approved", "cited with approval")
OVERRULING = ("overruled", "overruled by")

CODE = r"Ind(?:iana)?\.?\s*Code\s*§\s*[\d\-\.]+"
CODE_SHORT = r"I\.C\.\s*§\s*[\d\-\.]+"
STATUTE = rf"(?:{CODE}|{CODE_SHORT})"
LOOKUP_SIGN = rf"(?i)(?:{CODE}|{CODE_SHORT}|\d+\s+(?:F\.|Ind\.|N\.E\.)\s*\d+|[A-Z][a-z]+\s+v\.\s+[A-Z][a-z]+|§\s*[\d\-\.]+)"
QUESTION_SIGN = r"(?i)\b(?:what|how|why|when|explain|define|describe|analyze|summarize|is\s+it)\b"
CHUNK_CITATION = rf"(?:{CODE}|{CODE_SHORT}|\d+\s+Ind\.?\s+\d+|\d+\s+N\.E\.(?:2d|3d)?\s+\d+|[A-Z][a-z]+\s+v\.\s+[A-Z][a-z]+[\w\s,]+)"
SECTION = r"(?:^|\n)(?:(?:SECTION|SEC\.?|ARTICLE|RULE|CHAPTER|PART)\s+[\dA-Z]+\.?|[IVX]{1,6}\.|\d{1,3}(?:\.\d{1,3})*\.|§\s*[\d\-\.]+)[^\n]{0,120}"
SOURCE_MARK = r"\[SOURCE:\s*([^\],]+?)(?:,\s*§[^\]]+)?\]"
ASSERTION = r"(?i)\b(?:requires?|states?|provides?|mandates?|prohibits?|held|ruled|decided)\b"
CLAIM = rf"(?:{CODE}|\d+\s+(?:F\.\d+|Ind\.?|N\.E\.(?:2d|3d)?)\s+\d+|\b[A-Z][a-z]+\s+v\.\s+[A-Z][a-z]+)"
LEGAL_TERM = r"\b(?:statute|section|holding|court|affirmed|reversed|remanded|enjoined|convicted)\b"
PARTY = r"(?:Plaintiff|Defendant|Petitioner|Respondent)[:\s]+([A-Z][A-Za-z\s,\.]+)"
DEADLINE = r"(?i)\b(?:within \d+ days?|by [A-Z][a-z]+ \d{1,2},?\s*\d{4}|deadline[:\s]+[^\n\.]+)\b"
FALLBACK_SIGN = "do not contain sufficient information"

SSN = r"\bXXX-XX-(\d{4})\b"
BIRTH = r"(?i)\b(?:DOB|born)[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})\b"
ADDRESS = r"(?i)\b\d{3,5}\s+[A-Z][a-z]+\s+(?:St|Ave|Blvd|Dr|Ln|Rd|Way)\b"
QUITCLAIM = r"(?i)\bquitclaim\s+deed\b"
NOMINAL = r"(?i)\bfor\s+(?:the\s+sum\s+of\s+)?\$(?:1|10|100)\.?00?\b"
NUMBERED_ENTITY = r"(?i)\bEntity\s*\d+\b|\bCo\.\s*\d+\b"
TRANSFER_ADDRESS = r"\b(\d{3,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*,?\s*(?:Indianapolis|Indiana)\b"

#: descriptions of indicators
BURST_TEXT = "Party '%s' filed %d cases in %d days starting %s."
SSN_TEXT = "SSN fragment ...%s appears in %d separate cases."
BIRTH_TEXT = "Date of birth %s appears in %d separate cases."
DEED_TEXT = "Found %d quitclaim deeds with nominal consideration ($1-$100), a common deed fraud pattern."
ENTITY_TEXT = "Found %d cases with numerically-named entities (e.g. 'Entity 42 LLC')."
TRANSFER_TEXT = "Property '%s' transferred %d times in %d days."

#: the counties of the state, in alphabetical order
COUNTY_NAMES = (
    "Adams", "Allen", "Bartholomew", "Benton", "Blackford", "Boone", "Brown", "Carroll", "Cass", "Clark", "Clay", "Clinton",
    "Crawford", "Daviess", "Dearborn", "Decatur", "DeKalb", "Delaware", "Dubois", "Elkhart", "Fayette", "Floyd", "Fountain", "Franklin",
    "Fulton", "Gibson", "Grant", "Greene", "Hamilton", "Hancock", "Harrison", "Hendricks", "Henry", "Howard", "Huntington", "Jackson",
    "Jasper", "Jay", "Jefferson", "Jennings", "Johnson", "Knox", "Kosciusko", "LaGrange", "Lake", "LaPorte", "Lawrence", "Madison",
    "Marion", "Marshall", "Martin", "Miami", "Monroe", "Montgomery", "Morgan", "Newton", "Noble", "Ohio", "Orange", "Owen",
    "Parke", "Perry", "Pike", "Porter", "Posey", "Pulaski", "Putnam", "Randolph", "Ripley", "Rush", "St. Joseph", "Scott",
    "Shelby", "Spencer", "Starke", "Steuben", "Sullivan", "Switzerland", "Tippecanoe", "Tipton", "Union", "Vanderburgh", "Vermillion", "Vigo",
    "Wabash", "Warren", "Warrick", "Washington", "Wayne", "Wells", "White", "Whitley",
)

#: code -> case type
CASE_CODES = {
    "CF": "Criminal Felony", "CM": "Criminal Misdemeanor", "IF": "Infraction", "CT": "Civil Tort", "CC": "Civil Collection", "PL": "Civil Plenary",
    "SC": "Small Claims", "DR": "Domestic Relations", "JP": "Juvenile — CHINS/TPR", "JD": "Juvenile — Delinquency", "JS": "Juvenile — Status",
    "GU": "Guardianship", "ES": "Estate", "TR": "Trust", "MH": "Mental Health", "PO": "Protective Order", "AD": "Adoption", "MI": "Miscellaneous",
    "PC": "Post-Conviction Relief", "EV": "Eviction", "MF": "Mortgage Foreclosure", "XP": "Expungement",
}
