"""Text measures of the retrieval layer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks between words.
BLANK = r"\s+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(words(F.lower(text)))


def token_estimate(text: Column) -> Column:
    """Words divided by 0.75, whole."""
    return F.floor(F.size(words(text)) / 0.75).cast("long")


def overlap(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Share of the distinct words of ``a`` that are in ``b``; ``empty`` where ``a`` has none."""
    x, y = word_set(a), word_set(b)
    return F.when(F.size(x) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` and blanks; trimmed, none empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


#: Abbreviations after which a sentence goes on, in capitals or not.
ABBREVIATIONS = ["Eq", "Fig", "Sec", "Ref", "Tab", "Ch", "Vol", "No", "pp", "et al", r"i\.e", r"e\.g", "vs", "cf", "approx", "alt", "inc"]


def protected_sentences(text: Column) -> Column:
    """Sentences that don't end at abbreviations or within decimals: cut only before a capital; trimmed, none empty."""
    guard = r"(?<=[.!?])" + "".join(rf"(?<!\b(?i:{a})\.)" for a in ABBREVIATIONS) + r"\s+(?=[A-Z])"
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), guard), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def relationship_type(raw: Column, known: list[str]) -> Column:
    """``operated by`` in any case and spacing as OPERATED_BY, if that is known; else null."""
    name = F.upper(F.regexp_replace(F.trim(raw), r"[\s_]+", "_"))
    return F.when(name.isin(known), name)


def either_case(pattern: str) -> str:
    """``pattern`` for letters A-Z of either case, in terms that all engines read alike: they differ in what other letters equal these,
    in what a boundary of words is beside letters beyond A-Z, and in what counts as white space."""
    word, out, i = r"\p{L}\p{N}_", "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out += f"(?:^|[^{word}])" if i == 0 else f"(?:[^{word}]|$)"
        elif two == r"\s":
            out += r"[ \t\n\x0B\f\r]"
        elif two[0] == "\\":
            out += two
        else:
            c = pattern[i]
            out += f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c
            i -= 1
        i += 2
    return out


def first_match(text: Column, rules: dict[str, list[str]], otherwise: str) -> Column:
    """The first name one of whose patterns is found, letters of either case. ``\\b`` stands only at the ends of a pattern."""
    out = F.lit(otherwise)
    for name, patterns in reversed(rules.items()):
        out = F.when(text.rlike("|".join(f"(?:{either_case(p)})" for p in patterns)), name).otherwise(out)
    return out


#: Patterns of agencies and kinds of documents, in order.
AGENCIES = {
    "NASA": [r"\bNASA\b", "National Aeronautics", "NASA/TM", "NASA/CR"], "ESA": [r"\bESA\b", "European Space Agency", "ESTEC", r"SP-\d{3}"], "ISRO": [r"\bISRO\b", "Indian Space Research", "VSSC", "SAC-"],
    "JAXA": [r"\bJAXA\b", "Japan Aerospace"], "CNSA": [r"\bCNSA\b", "China National Space"],
}
KINDS = {
    "mission_report": ["Mission Report", "Flight Report", "Post-Mission"], "technical_report": [r"Technical(?:\s+Note|\s+Memorandum|\s+Report)", r"TM-\d", r"TR-\d"],
    "research_paper": ["Abstract", "Journal of", r"IEEE\s+Trans", "Acta Astro"], "textbook": [r"Chapter \d", "Introduction to", "Fundamentals of"], "operator_manual": [r"Operator\s+Manual", r"User\s+Manual", r"ICD-\d"],
    "debris_study": ["Space Debris", "Mitigation", "Fragmentation"], "standards_doc": [r"ISO \d{4,}", "ECSS-", "MIL-STD-"],
}
#: Keywords of topics; those with capitals are looked for in lower-cased text, where they are never found.
TOPICS = {
    "orbital_mechanics": ["sgp4", "kepler", "propagat", "mean motion", "eccentricity", "inclination", "RAAN"], "conjunction_analysis": ["conjunction", "collision probab", "Foster", "miss distance", "TCA", "CDM", "Pc"],
    "debris_mitigation": ["debris", "deorbit", "mitigation", "IADC", "end-of-life", "passivation", "fragmentation"], "propulsion": ["thrust", "Isp", "propellant", "delta-v", "specific impulse", "burn"],
    "attitude_control": ["attitude", "ADCS", "reaction wheel", "momentum", "pointing", "star tracker"], "thermal_control": ["thermal", "heat pipe", "radiator", "MLI", "temperature", "thermal control"],
    "launch_vehicle": ["launch vehicle", "rocket", "stage", "fairing", "payload adapter", "trajectory"], "ground_segment": ["ground station", "telemetry", "command", "LEOP", "pass", "AOS", "LOS"],
    "space_weather": ["solar flare", "geomagnetic", "Kp index", "F10.7", "radiation", "storm"], "reentry": ["reentry", "decay", "atmospheric drag", "deorbit", "fragmentation event"],
}
#: Acronyms and what they stand for.
ACRONYMS = {
    "LEO": "Low Earth Orbit", "GEO": "Geostationary Orbit", "MEO": "Medium Earth Orbit", "SSO": "Sun-Synchronous Orbit", "HEO": "Highly Elliptical Orbit", "GTO": "Geostationary Transfer Orbit",
    "TLI": "Trans-Lunar Injection", "TCA": "Time of Closest Approach", "CDM": "Conjunction Data Message", "NORAD": "North American Aerospace Defense Command", "TLE": "Two-Line Element Set",
    "RAAN": "Right Ascension of Ascending Node", "SGP4": "Simplified General Perturbations 4", "ADCS": "Attitude Determination and Control System", "EPS": "Electrical Power System", "OBC": "On-Board Computer",
    "LEOP": "Launch and Early Orbit Phase", "AOS": "Acquisition of Signal", "LOS": "Loss of Signal", "NTRS": "NASA Technical Reports Server", "IADC": "Inter-Agency Space Debris Coordination Committee",
    "ECSS": "European Cooperation for Space Standardization", "BSTAR": "Drag Term in SGP4 (ballistic coefficient)", "Pc": "Collision Probability", "HBR": "Hard Body Radius",
    "RTN": "Radial-Transverse-Normal frame", "LVLH": "Local Vertical Local Horizontal frame",
}
#: Patterns of entities, and how many of each a chunk keeps.
ENTITIES = {
    "satellites": (r"(?i)\b(?:ISS|Starlink-\d+|OneWeb-\d+|CARTOSAT-\d+|RESOURCESAT-\d+|RISAT-\d+|Sentinel-\d+[A-Z]?|MetOp-[A-C]|GPS\s+(?:IIF|IIIA?)-\d+|Inmarsat-\d+[A-Z]?|Iridium-\d+|Hubble Space Telescope|HST|James Webb Space Telescope|JWST|[A-Z]{2,6}-\d{1,2}[A-Z]?)", 10),
    "missions": (r"(?i)\b(?:Apollo\s+\d+|Artemis\s+(?:I{1,3}|\d+)|Mars\s+(?:Science Laboratory|Perseverance|Curiosity|Ingenuity)|Chandrayaan-\d+|Mangalyaan|Gaganyaan|Rosetta|BepiColombo|Solar Orbiter|Parker Solar Probe|Voyager\s+[12]|Pioneer\s+(?:10|11)|New Horizons|Cassini|Juno|Dawn|(?:PSLV|GSLV|Ariane|Falcon|Atlas|Delta|Vulcan|SLS)-C?\d+)", 10),
    "vehicles": (r"(?i)\b(?:PSLV(?:-C\d+|-XL|-G|-CA)?|GSLV(?:\s+Mk\s*(?:II|III))?|LVM3|SLV|ASLV|Falcon\s+(?:9|Heavy|1)|Starship|New\s+Shepard|New\s+Glenn|Ariane\s+(?:5|6|62|64)|Atlas\s+V|Delta\s+IV(?:\s+Heavy)?|Vulcan|Space\s+Launch\s+System|SLS|Soyuz-\d+\.\d+|Proton-[MK]|H-II[AB]?|Epsilon|H3|Long\s+March\s*-?\d+)", 5),
    "orbits": (r"(?i)\b(?:\d+(?:\.\d+)?\s*km\s+(?:LEO|MEO|GEO|SSO|HEO|VLEO)|(?:LEO|MEO|GEO|SSO|HEO|VLEO|GTO|TLI)\s+orbit|\d+(?:\.\d+)?°?\s+inclination|geostationary(?:\s+orbit)?|sun-synchronous(?:\s+orbit)?|Molniya\s+orbit|Tundra\s+orbit)", 5),
    "numbers": (r"\b(?:\d+(?:\.\d+)?\s*(?:km|km/s|m/s|deg|°|kg|kN|kW|MHz|GHz|yr|days?)|Isp\s*=\s*\d+\s*s|Pc\s*[=≈]\s*[\d.]+(?:×10[⁻-]\d+)?|ΔV\s*=\s*[\d.]+\s*m/s|e\s*=\s*[\d.]{3,}|i\s*=\s*[\d.]+°)", 15),
    "organisations": (r"\b(NASA|ESA|ISRO|JAXA|CNSA|ROSCOSMOS|SpaceX|Boeing|Airbus Defence|Northrop Grumman|Lockheed Martin|18 SWS|CARA|USSPACECOM)\b", 8),
}


def agency(text: Column) -> Column:
    return first_match(F.substring(text, 1, 2000), AGENCIES, "OTHER")


def document_kind(text: Column) -> Column:
    return first_match(F.substring(text, 1, 3000), KINDS, "unknown")


def topics(text: Column) -> Column:
    low = F.lower(text)
    found = []
    for name, keys in TOPICS.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def entities(text: Column, kind: str) -> Column:
    """The distinct matches of a kind in order, as many as a chunk keeps."""
    pattern, most = ENTITIES[kind]
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), 1, most)


def expand_acronyms(text: Column, table: dict[str, str] = ACRONYMS) -> Column:
    """The first whole-word occurrence of each acronym gets its meaning in brackets; one after the other, in order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()])

    def step(t: Column, x: Column) -> Column:
        at = F.regexp_instr(t, F.concat(F.lit(r"\b"), x["k"], F.lit(r"\b")))
        return F.when(at > 0, F.overlay(t, F.concat(x["k"], F.lit(" ("), x["v"], F.lit(")")), at, F.length(x["k"]))).otherwise(t)

    return F.aggregate(pairs, text, step)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-case words, each with two blanks before and one after it."""
    padded = F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams in all of both."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def ieee(key: Column, authors: Column, title: Column, agency: Column, year: Column, report: Column, doi: Column, url: Column) -> Column:
    """A reference in IEEE style; parts that are missing are left out."""
    who = F.concat(F.array_join(F.slice(authors, 1, 3), "; "), F.when(F.size(authors) > 3, " et al.").otherwise(""))
    tail = F.when(doi.isNotNull(), F.concat(F.lit(" DOI: "), doi, F.lit("."))).when(url.isNotNull(), F.concat(F.lit(" "), url, F.lit("."))).otherwise("")
    report_part = F.when(report.isNotNull(), F.concat(F.lit(" "), report, F.lit("."))).otherwise("")
    return F.concat(key, F.lit(" "), who, F.lit(', "'), title, F.lit('," '), agency, F.lit(", "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("."), report_part, tail)


def apa(authors: Column, title: Column, agency: Column, year: Column, doi: Column) -> Column:
    who = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, ", et al.").otherwise(""))
    tail = F.when(doi.isNotNull(), F.concat(F.lit(" https://doi.org/"), doi)).otherwise("")
    return F.concat(who, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). *"), title, F.lit("*. "), agency, F.lit("."), tail)


def numbers(text: Column) -> Column:
    """Distinct numbers in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double")))


def numeric_accuracy(truth: Column, answer: Column, tolerance: float = 0.1) -> Column:
    """Share of the numbers in ``truth`` that have one in ``answer`` within the tolerance; a zero needs a zero; 1 without numbers."""
    mine, theirs = numbers(truth), numbers(answer)
    near = lambda g: F.exists(theirs, lambda a: F.when(g == 0, a == 0).otherwise(F.abs(a - g) <= tolerance * F.abs(g)))
    return F.when(F.size(mine) == 0, 1.0).otherwise(F.size(F.filter(mine, near)) / F.size(mine))


#: Words that hedge.
HEDGES = r"(?i)approximately|roughly|about|around|may be|might be|could be|possibly|typically|generally|usually|often|it is believed|it has been suggested|further analysis is needed|insufficient data"


def hedged(text: Column) -> Column:
    """Sentences that hedge or are marked as uncertain."""
    return F.array_distinct(F.filter(sentences(text), lambda s: s.rlike(HEDGES) | s.contains("[UNCERTAIN]")))
