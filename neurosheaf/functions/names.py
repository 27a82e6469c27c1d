"""Channel names, types and units, as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .montage import ALIASES, standard_positions
from .units import MICROVOLTS

#: What recorders put before and after an electrode's name.
PREFIX = r"(?i)^EEG[ _:\-]+"
REFERENCE = r"(?i)[ _:\-]+(ref|le|re|avg|ar|car|a1a2|m1m2|a1\+a2|m1\+m2|a1|a2|m1|m2|lm)$"
#: Channel types by name, tried in this order after the known electrodes.
TYPE_PATTERNS = [
    ("stim", r"(?i)^(sti|stim|status|trig|trigger|event|marker)[ _0-9]*"),
    ("eog", r"(?i)(eog|^(v|h)eo|^loc$|^roc$)"),
    ("ecg", r"(?i)(ecg|ekg)"),
    ("emg", r"(?i)(emg|chin)"),
    ("resp", r"(?i)(resp|thor|abdo|airflow|nasal)"),
    ("misc", r"(?i)(gsr|eda|spo2|sao2|temp|accel|gyro|aux|^exg[0-9]+$|pleth|pulse|light|photo)"),
]


@cache
def _known() -> dict[str, str]:
    """Canonical names by lower-case ones, old names included."""
    names = {n.lower(): n for n in standard_positions()}
    return names | {old.lower(): new for old, new in ALIASES.items()}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def standard_name(name: Column) -> Column:
    """The canonical name of a 10-10 electrode in any case, T3, T4, T5 and T6 by their new names; else null."""
    return _lookup(_known(), F.lower(name))


def clean_channel_name(name: Column) -> Column:
    """A recorder's name as a canonical electrode name, if it is one without its prefix, dots and reference; else only stripped."""
    bare = F.trim(F.replace(name, F.lit("\0"), F.lit("")))
    short = F.regexp_replace(F.regexp_replace(bare, PREFIX, ""), r"[. ]+$", "")
    dotless = F.regexp_replace(short, r"[. ]", "")
    untagged = F.regexp_replace(F.regexp_replace(short, REFERENCE, ""), r"[. ]", "")
    return F.coalesce(standard_name(dotless), standard_name(untagged), bare)


def channel_type(name: Column, unit: Column | None = None) -> Column:
    """eeg for known electrodes, else the first type whose pattern fits, misc for units that aren't voltages, else eeg."""
    kind = F.when(standard_name(name).isNotNull(), "eeg")
    for label, pattern in TYPE_PATTERNS:
        kind = kind.when(name.rlike(pattern), label)
    if unit is not None:
        kind = kind.when(unit.isNotNull() & (F.trim(unit) != "") & microvolts(unit).isNull(), "misc")
    return kind.otherwise("eeg")


def microvolts(unit: Column) -> Column:
    """How many microvolts a unit is; null if it is no voltage."""
    return _lookup(MICROVOLTS, F.trim(unit))
