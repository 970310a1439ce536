"""Identifiers, source tiers and confidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts by tier.
TIER_1 = ["nasa.gov", "esa.int", "spacex.com", "isro.gov.in", "roscosmos.ru", "jaxa.jp", "csa-asc.gc.ca", "cnsa.gov.cn", "space-track.org", "boeing.com", "lockheedmartin.com", "northropgrumman.com", "airbus.com", "thalesaleniaspace.com"]
TIER_2 = ["celestrak.org", "unoosa.org", "itu.int", "sdo.esoc.esa.int", "nssdc.gsfc.nasa.gov"]
TIER_3 = ["edu", "ac.uk", "ac.jp", "ac.in", "ac.au", "arxiv.org", "dl.acm.org", "ieeexplore.ieee.org", "aiaa.org", "springer.com", "elsevier.com", "tandfonline.com", "nature.com", "science.org", "researchgate.net", "semanticscholar.org"]
#: Confidence of each tier, authority of each kind of source, weight of each verification status.
TIER_CONFIDENCE = {1: 1.00, 2: 0.95, 3: 0.85, 4: 0.70, 5: 0.65, 6: 0.50}
AUTHORITY = {"official": 1.00, "official_registry": 0.95, "peer_reviewed": 0.85, "reference": 0.70, "news": 0.65, "community": 0.50, "ai_generated": 0.60}
VERIFICATION = {"authoritative": 1.00, "human_verified": 0.90, "ai_verified": 0.75, "unverified": 0.50, "disputed": 0.30}


def lookup(key: Column, table: dict, default=None) -> Column:
    """The table's value for a key, as a chain of comparisons that the optimizer folds."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def host(url: Column) -> Column:
    """Lower-case host of a url without user, port and a leading ``www.``; null if it has none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def source_tier(url: Column) -> Column:
    """1, 2 or 3 for a host on the list of that tier or below one, else 6."""
    h, out = host(url), F.lit(6)
    for tier, names in ((3, TIER_3), (2, TIER_2), (1, TIER_1)):
        pattern = "(^|[.])(" + "|".join(n.replace(".", "[.]") for n in names) + ")$"
        out = F.when(h.rlike(pattern), tier).otherwise(out)
    return out


def aqid(entity_class: Column, name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit("AQID-"), entity_class, F.lit("-"), slug)


def aqid_valid(value: Column) -> Column:
    return value.rlike(r"^AQID-[A-Z_]+-[A-Z0-9\-]+$")


def aqid_class(value: Column) -> Column:
    parts = F.split(value, "-", 3)
    return F.when((F.size(parts) == 3) & (parts[0] == "AQID"), parts[1])


def composite_confidence(source_type: Column, verification: Column, confidence: Column) -> Column:
    return F.round(lookup(source_type, AUTHORITY, 0.5) * 0.40 + lookup(verification, VERIFICATION, 0.5) * 0.35 + confidence * 0.25, 4)


def entity_confidence(best_authority: Column, verification: Column, n_urls: Column) -> Column:
    """From the best authority, the verification status and the number of distinct urls; 0.3 without a source (null authority)."""
    corroboration = F.when(n_urls == 1, 0.5).when(n_urls == 2, 0.7).otherwise(0.9)
    return F.coalesce(F.round(best_authority * 0.40 + lookup(verification, VERIFICATION, 0.5) * 0.35 + corroboration * 0.25, 4), F.lit(0.3))


def completeness(columns: list[Column]) -> Column:
    """Share of the columns that are neither null nor empty (give arrays and maps by their size)."""
    filled = lambda c: F.when(c.isNotNull() & ~c.cast("string").isin("", "0"), 1).otherwise(0)
    return F.round(sum((filled(c) for c in columns[1:]), filled(columns[0])) / len(columns), 4)


def bump_version(version: Column) -> Column:
    """The last dotted part plus one."""
    head, last = F.regexp_extract(version, r"^(.*\.)?([0-9]+)$", 1), F.regexp_extract(version, r"([0-9]+)$", 1)
    return F.concat(head, (last.cast("int") + 1).cast("string"))


#: Names of entity types, by class.
ENTITY_TYPES = {
    "COUNTRY": ["country", "nation"], "GOV_AGENCY": ["space agency", "government agency", "agency"], "COMPANY": ["company", "corporation", "commercial", "startup"],
    "UNIVERSITY": ["university"], "RESEARCH_ORG": ["research organization"], "PERSON": ["person", "scientist", "engineer"], "LAUNCH_VEHICLE": ["launch vehicle", "rocket"],
    "SATELLITE": ["satellite"], "PAYLOAD": ["payload"], "SPACECRAFT": ["spacecraft"], "DEBRIS": ["debris"], "LAUNCH_SITE": ["launch site", "spaceport"], "GROUND_STATION": ["ground station"],
    "PROGRAM": ["program"], "MISSION": ["mission"], "CONSTELLATION": ["constellation"], "TECHNOLOGY": ["technology"], "STANDARD": ["standard"], "SPECIFICATION": ["specification"],
    "RESEARCH_PAPER": ["research paper", "paper"], "PATENT": ["patent"], "CONTRACT": ["contract"], "INVESTMENT": ["investment"], "POLICY": ["policy"], "AGREEMENT": ["agreement", "treaty"],
    "INCIDENT": ["incident"], "ANOMALY": ["anomaly"], "HISTORICAL_EVENT": ["event"], "ASTEROID": ["asteroid"], "COMET": ["comet"], "CELESTIAL_BODY": ["celestial body"],
}


def entity_class(raw: Column) -> Column:
    """The class of a type name in any case; null for an unknown one."""
    t, out = F.lower(F.trim(raw)), F.lit(None).cast("string")
    for name, words in ENTITY_TYPES.items():
        out = F.when(t.isin(words), name).otherwise(out)
    return out
