"""Word tables of the normalisers."""

# The results depend on exactly these words. Tokens of names and addresses, and what they stand for.
ABBREVIATIONS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "bd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway",
    "pkwy": "parkway", "ct": "court", "pl": "place", "sq": "square", "cir": "circle",
    "ter": "terrace", "trl": "trail", "fwy": "freeway", "expy": "expressway",
    "ste": "suite", "apt": "apartment", "fl": "floor", "flr": "floor", "bldg": "building",
    "rm": "room", "no": "number", "num": "number",
    "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "nr": "near", "opp": "opposite", "mkt": "market", "ngr": "nagar",
    "pvt": "private", "prvt": "private", "ltd": "limited",
    "corp": "corporation", "co": "company", "inc": "incorporated", "intl": "international",
    "mfg": "manufacturing", "svc": "services", "svcs": "services", "bros": "brothers",
    "assoc": "associates", "mgmt": "management",
}

# Words that say little about who a business is.
NAME_STOPWORDS = [
    "private", "limited", "company", "corporation", "incorporated", "llc", "llp", "lp",
    "pc", "pllc", "plc", "pa", "the", "and", "of", "dba", "aka",
    "sa", "sas", "sasu", "sarl", "eurl", "snc", "gmbh", "ag",
    "et", "de", "du", "des", "la", "le", "les", "d", "l",
]

# Legal forms at the end of a name (character-gram plan), and their classes.
LEGAL_SUFFIXES = {
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp",
    "company": "co", "co": "co", "limited": "ltd", "ltd": "ltd",
    "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc",
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "opc": "opc",
    "sa": "sa", "sas": "sas", "sasu": "sas", "sarl": "sarl", "eurl": "sarl",
    "sci": "sci", "snc": "snc", "scop": "scop",
}

# Words of names (character-gram plan).
NAME_WORDS = {
    "intl": "international", "natl": "national", "mfg": "manufacturing", "svc": "services",
    "svcs": "services", "srvs": "services", "tech": "technologies", "techs": "technologies",
    "assoc": "associates", "bros": "brothers", "grp": "group", "ent": "enterprises",
    "entp": "enterprises", "ind": "industries", "sri": "shri", "shree": "shri", "laxmi": "lakshmi",
}

# Words of addresses (character-gram plan), for any country and for some.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "bd": "boulevard", "ln": "lane", "dr": "drive",
    "hwy": "highway", "pkwy": "parkway", "ct": "court", "pl": "place",
    "sq": "square", "ste": "suite", "fl": "floor", "flr": "floor",
    "apt": "apartment", "bldg": "building", "no": "number",
    "n": "north", "s": "south", "e": "east", "w": "west",
    "nr": "near", "opp": "opposite", "bhd": "behind",
}
ADDRESS_WORDS_BY_COUNTRY = {
    "india": {"mg": "mahatma gandhi", "ngr": "nagar", "clny": "colony", "sec": "sector"},
    "france": {"st": "saint", "ste": "sainte", "r": "rue", "chem": "chemin", "fbg": "faubourg", "imp": "impasse", "rte": "route", "all": "allee"},
}
