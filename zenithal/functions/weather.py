"""Space weather: storm scales, drag and impact, as column expressions.

Three sets of rules exist side by side and differ on purpose: the service's, the twin's (``twin_``) and the agents' (``agent_``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def storm_level(kp: Column) -> Column:
    k = F.least(F.lit(9), F.floor(kp).cast("int"))
    return F.when(k >= 5, F.concat(F.lit("G"), (k - 4).cast("string"))).otherwise("NONE")


def agent_storm_level(kp: Column) -> Column:
    return F.when(kp >= 8, "G4").when(kp >= 6, "G3").when(kp >= 5, "G2").when(kp >= 4, "G1").otherwise("none")


def severity(kp: Column) -> Column:
    return F.when(kp >= 8, "SEVERE").when(kp >= 6, "STRONG").when(kp >= 5, "MODERATE").when(kp >= 4, "MINOR").otherwise("NONE")


#: Ap for kp 0 to 9.
AP = [0.0, 2.0, 4.0, 7.0, 15.0, 27.0, 48.0, 80.0, 140.0, 240.0]


def kp_to_ap(kp: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in AP]), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(9.0), kp))).cast("int") + 1)


def drag_multiplier(f107: Column) -> Column:
    return F.round(F.greatest(F.lit(0.3), F.least(F.lit(5.0), 1.0 + 0.012 * (f107 - 150.0))), 3)


def twin_drag_multiplier(f107: Column) -> Column:
    return F.greatest(F.lit(0.5), 1.0 + 0.012 * (f107 - 150.0))


def impact_score(kp: Column, f107: Column) -> Column:
    flux = F.least(F.lit(4.0), F.greatest(F.lit(0.0), (f107 - 100.0) / 100.0) * 4.0)
    return F.round(F.least(F.lit(10.0), kp / 9.0 * 6.0 + flux), 2)


def alert_severity(message: Column) -> Column:
    """By the first scale whose word or level occurs anywhere in the message."""
    out, m = F.lit("INFO"), F.upper(message)
    for i, word in enumerate(["MINOR", "MODERATE", "STRONG", "SEVERE", "EXTREME"], 1):
        found = m.contains(word)
        for scale in "GSR":
            found = found | m.contains(f"{scale}{i}")
        out = F.when(found, word).otherwise(out)
    return out


def density_effect_pct(kp: Column, f107: Column) -> Column:
    """Whole per cent, toward zero, within -30 to 200."""
    x = (f107 - 150) * 1.2 + (kp - 3) * 10
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.greatest(F.lit(-30), F.least(F.lit(200), whole.cast("int")))


def twin_impact(kp: Column) -> Column:
    out = F.when(kp >= 7, "Severe drag augmentation — emergency TLE refresh recommended").when(kp >= 5, "Elevated drag — monitor LEO objects closely")
    return out.when(kp >= 4, "Moderate drag increase").otherwise("Nominal conditions")


def agent_action(kp: Column) -> Column:
    out = F.when(kp >= 8, "Suspend all operations; extreme geomagnetic storm").when(kp >= 6, "Delay maneuvers; significant drag uncertainty")
    return out.when(kp >= 5, "Monitor closely; mild storm conditions").when(kp >= 4, "No restrictions; minor activity").otherwise("Nominal operations; quiet conditions")


def agent_density_change_pct(f107: Column, kp: Column) -> Column:
    return ((1 + 0.012 * (f107 - 70)) * (1 + 0.05 * F.greatest(F.lit(0.0), kp - 3)) - 1) * 100


def forecast(kp: Column, hours: int) -> Column:
    """Array of (hour, kp_projected, storm_level): every 3 hours up to 72, a twentieth less an hour, never under 1."""
    def at(h: Column) -> Column:
        p = F.greatest(F.lit(1.0), kp - h * 0.05)
        return F.struct(h.alias("hour"), F.round(p, 1).alias("kp_projected"), storm_level(p).alias("storm_level"))

    return F.transform(F.sequence(F.lit(0), F.lit(min(hours, 72)), F.lit(3)), at)


def storm_probabilities(kp: Column) -> dict[str, Column]:
    clamp = lambda x, most: F.least(F.lit(most), F.greatest(F.lit(0.0), x))
    return {"g1_or_above": clamp((kp - 3.0) / 6.0, 0.95), "g3_or_above": clamp((kp - 6.0) / 3.0, 0.95), "g5": clamp(kp - 8.0, 0.90)}


def drag_outlook(score: Column) -> Column:
    out = F.when(score >= 6, "Elevated drag expected — maneuver budgets should account for density increase")
    return out.when(score >= 4, "Moderate drag increase — LEO operators should monitor").otherwise("Nominal drag conditions forecast")
