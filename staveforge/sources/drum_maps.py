"""Drum maps and layer slots as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Source note to target note of the General MIDI map.
GM = {32: 36, 35: 36, 36: 36, 37: 38, 38: 38, 39: 38, 40: 38, 41: 41, 42: 42, 43: 43, 44: 44, 45: 45, 46: 46, 47: 47, 48: 48, 49: 49, 50: 50, 51: 49, 52: 49, 55: 49, 57: 49, 59: 49}
# Source note to place on the candy layout, octave 1 at c1.
CANDY = {32: "C1", 36: "C1", 39: "G1", 45: "D2", 46: "C2", 50: "F2", 57: "C3"}
_NATURAL = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
# Slot families, their first notes on the GM map and on the candy map, and those that are on by default.
SLOT_FAMILIES = ["kick", "snare", "clap", "hh", "hh_open", "tom_l", "tom_m", "tom_h", "perc", "cym", "fx", "acc"]
GM_SLOTS = {"kick": (36, 38, 40), "snare": (38, 40, 41), "clap": (39, 41, 43), "hh": (42, 44, 46), "hh_open": (46, 48, 50), "tom_l": (45, 47, 48), "tom_m": (47, 48, 50), "tom_h": (50, 52, 53), "perc": (51, 53, 55), "cym": (49, 51, 53), "fx": (47, 48, 50), "acc": (38, 40, 41)}
CANDY_SLOTS = {"kick": (36, 38, 40), "snare": (40, 41, 43), "clap": (43, 45, 47), "hh": (48, 49, 50), "hh_open": (48, 50, 52), "tom_l": (50, 52, 53), "tom_m": (52, 53, 55), "tom_h": (53, 55, 57), "perc": (55, 57, 59), "cym": (60, 62, 64), "fx": (47, 48, 50), "acc": (38, 40, 41)}
ENABLED = {"kick_1", "snare_1", "clap_1", "hh_1", "hh_open_1", "tom_l_1", "tom_m_1", "tom_h_1", "perc_1", "cym_1"}


def layout_note(name: str, c1: int) -> int:
    """A natural note name on a layout whose C1 is c1."""
    letter, octave = name[0].upper(), int(name[1:])
    note = c1 + 12 * (octave - 1) + _NATURAL[letter]
    if not 0 <= note <= 127:
        raise ValueError(f"{name} is outside 0..127 with C1 = {c1}")
    return note


def preset(spark: SparkSession, name: str, c1: int = 36) -> DataFrame:
    """(source_note, target_note) of gm, sitala or ujam-candy."""
    if name in ("gm", "sitala"):
        rows = list(GM.items())
    elif name == "ujam-candy":
        rows = [(a, layout_note(b, c1)) for a, b in CANDY.items()]
    else:
        raise ValueError(f"unknown drum map {name}")
    return spark.createDataFrame(rows, "source_note int, target_note int")


def custom(spark: SparkSession, text: str) -> DataFrame:
    """(source_note, target_note) from JSON with name and notes; notes outside 0..127 are an error."""
    doc = json.loads(text)
    if "name" not in doc or not doc.get("notes"):
        raise ValueError("a drum map needs name and notes")
    rows = [(int(a), int(b)) for a, b in doc["notes"].items()]
    if any(not 0 <= x <= 127 for r in rows for x in r):
        raise ValueError("notes must be in 0..127")
    return spark.createDataFrame(rows, "source_note int, target_note int")


def slots(spark: SparkSession, target_map: str = "gm") -> DataFrame:
    """(slot, ordinal, note, enabled) of the default layer mapping; an unknown map is gm."""
    notes = CANDY_SLOTS if target_map == "ujam-candy" else GM_SLOTS
    rows = [(f"{f}_{i + 1}", 3 * k + i, notes[f][i], f"{f}_{i + 1}" in ENABLED) for k, f in enumerate(SLOT_FAMILIES) for i in range(3)]
    return spark.createDataFrame(rows, "slot string, ordinal int, note int, enabled boolean")
