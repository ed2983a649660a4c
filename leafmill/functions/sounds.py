"""Sound effects as columns: a dictionary with kinds, drawn-out forms, spelling in the target language.

The dictionary is a literal map, so a look-up stays inside of the projection. The same rules are
given as DuckDB expressions by ``sql_spelling``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sound effects and how the target language writes them.
WRITTEN = {
    "BOOM": "BUM", "KABOOM": "KA-BUM", "KA-BOOM": "KA-BUM", "KRAKOOM": "KRA-KUM", "THOOM": "TUM", "BANG": "GURS", "BAM": "BEM",
    "WHAM": "VEM", "POW": "POU", "KAPOW": "KA-POU", "KA-POU": "KA-POU", "THUMP": "DUMP", "POP": "PAQ", "SMACK": "SHAP",
    "THWIP": "TVIP", "SWOOSH": "VUSH", "WHOOSH": "VUSH", "SIW": "SIV",
    "TEKK": "TEKK", "TEXK": "TEKK", "CHUK": "CHUK", "CHIK": "CHIK", "CHK": "CHK", "CLANG": "JANG", "CLICK": "CHIQ", "ZAP": "ZAP", "PING": "ZING", "PANG": "PANG", "ZING": "ZING",
    "CRASH": "QARS", "KRAK": "QARS", "SNAP": "QARS", "CRACKLE": "QARS-QURS", "SNIKT": "SNIKT", "SHKK": "SHKK", "SKRRR": "SKRRR", "RATATAT": "TRA-TA-TA",
    "SPLASH": "CHILP", "GULP": "QULT",
    "ROAR": "NA'RA", "GRRR": "GRRR", "HISS": "FISS", "RUMBLE": "GUDUR", "VROOOM": "VRU-U-UM", "SKREEE": "SKRIII", "CHOMP": "XAMP",
    "UGH": "UX", "AAAH": "AAAH", "ARGH": "ARX", "YAAAH": "YAAAH", "KOFF": "KXA", "COUGH": "YO'TAL", "GASP": "UH", "SNORT": "PISH", "WHEEZE": "XIQ", "AHEM": "EHM", "PST": "PST", "SHH": "SHSH",
}
# Sound effects by kind; a word of several kinds is of the first.
KINDS = {
    "impact_explosion": "BOOM KABOOM KA-BOOM KRAKOOM THOOM BANG BAM WHAM POW KAPOW KA-POU THUMP POP SMACK BASH BONK CLOBBER SLAM THUD".split(),
    "web_speed": "THWIP SWOOSH WHOOSH SIW SIV ZIP ZOOM SWISH FLAP".split(),
    "mechanical_tech": "TEKK TEXK CHUK CHIK CHK CLANG CLICK ZAP PING PANG ZING BEEP WHIR BUZZ CLINK TICK".split(),
    "destruction_sharp": "CRASH KRAK SNAP CRACKLE SNIKT SHKK SKRRR RATATAT SMASH RIP TEAR SLASH CHOP SHRED".split(),
    "creature_vocal": "ROAR GRRR HISS RUMBLE VROOOM SKREEE CHOMP GROWL HOWL SNARL SCREECH".split(),
    "human_vocal_bodily": "UGH AAAH ARGH YAAAH KOFF COUGH GASP SNORT WHEEZE AHEM PST SHH GULP SPLASH OOF PHEW YAWN".split(),
}
# How the target language names the kinds; words of speech that are no sounds.
LABELS = {
    "impact_explosion": "Zarba / Portlash",
    "web_speed": "Tezlik / To'r ovozi",
    "mechanical_tech": "Mexanik / Texnologiya",
    "destruction_sharp": "Sinish / Qirsillash",
    "creature_vocal": "Maxluq / Hayvon ovozi",
    "human_vocal_bodily": "Insoniy tovush / Qichqiriq",
}
SPOKEN = "YES NO WHY HOW WHAT WHO NOW HEY HI HELLO PLEASE THANKS OK OKAY STOP WAIT HELP LOOK RUN".split()
# Letter groups of other sounds, in the order in which they are rewritten.
LETTERS = (("THW", "TV"), ("TH", "T"), ("WH", "V"), ("W", "V"), ("OO", "U"), ("EE", "I"), ("CK", "K"), ("PH", "F"), ("X", "KS"), ("C", "K"))
#: What may stand behind a sound.
TAIL = "[!?:.\\-_—]*\\z"
DRAWN = "([A-Z])\\1{2,}"


def dictionary() -> list[tuple[str, str, int, float]]:
    """(name, kind, rank, confidence of an exact match); names without a kind come last."""
    rows = [(w, kind, rank, 0.99) for rank, (kind, words) in enumerate(KINDS.items()) for w in words]
    named = {r[0] for r in rows}
    return rows + [(w, "impact_explosion", len(KINDS), 0.90) for w in WRITTEN if w not in named]


def tail_of(text: Column) -> Column:
    return F.regexp_extract(text, f"({TAIL})", 1)


def core_of(text: Column) -> Column:
    return F.upper(F.rtrim(F.regexp_replace(text, TAIL, "")))


def letters_of(core: Column) -> Column:
    return F.regexp_replace(core, "[^A-Z]+", "")


def forms(core: Column) -> Column:
    """The names under which a sound is looked up: as it is, letters only, drawn-out letters twice and once."""
    key = letters_of(core)
    return F.array_distinct(F.array(core, key, F.regexp_replace(key, DRAWN, "$1$1"), F.regexp_replace(key, DRAWN, "$1")))


def _table() -> Column:
    return F.create_map(*[F.lit(x) for pair in WRITTEN.items() for x in pair])


def _known(core: Column, table: Column) -> Column:
    """The spelling that the dictionary gives, drawn out as the sound is; null if it gives none."""
    key = letters_of(core)
    run = F.regexp_extract(key, DRAWN, 0)

    def drawn(times: int) -> Column:
        base = table[F.regexp_replace(key, DRAWN, "$1" * times)]
        letter = F.when(run.startswith("O") & base.contains("U"), "U").otherwise(F.substring(run, 1, 1))
        stretched = F.regexp_replace(base, F.concat(letter, F.lit("+")), _repeated(letter, F.length(run)))
        return F.when((run != "") & base.contains(letter), stretched)

    return F.coalesce(table[core], table[key], drawn(2), drawn(1))


def _repeated(letter: Column, n: Column) -> Column:
    return F.array_join(F.array_repeat(letter, n), "")


def _by_letters(core: Column) -> Column:
    for group, written in LETTERS:
        core = F.replace(core, F.lit(group), F.lit(written))
    return core


def spelling(text: Column) -> Column:
    """A sound effect in the target language; null gives an empty text.

    A known sound is looked up, also with drawn-out letters, which stay so; the parts of one with
    hyphens are spelled each; others go by letter groups. What stands behind a sound stays."""
    table = _table()
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+\\z", "")
    core = core_of(whole)

    def part(x: Column) -> Column:
        return F.concat(F.coalesce(_known(core_of(x), table), _by_letters(core_of(x))), tail_of(x))

    parted = F.when(core.contains("-"), F.array_join(F.transform(F.split(core, "-", -1), part), "-"))
    return F.concat(F.coalesce(_known(core, table), parted, _by_letters(core)), tail_of(whole))


# ---- the same in DuckDB's SQL ----

_RUN = "|".join(f"{c}{{3,}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_EACH = "[" + ", ".join(f"'{c}'" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "]"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"


def sql_core(text: str) -> str:
    return f"upper(replace(rtrim(regexp_replace({text}, '{TAIL}', '')), 'ß', 'SS'))"


def sql_letters(core: str) -> str:
    return f"regexp_replace({core}, '[^A-Z]+', '', 'g')"


def sql_shortened(key: str, times: int) -> str:
    return f"list_reduce({_EACH}, lambda word, c: regexp_replace(word, c || '{{3,}}', repeat(c, {times}), 'g'), {key})"


def sql_known(core: str, table: str) -> str:
    key = sql_letters(core)
    run = f"regexp_extract({key}, '{_RUN}')"
    tries = [f"{table}[{core}]", f"{table}[{key}]"]
    for times in (2, 1):
        base = f"{table}[{sql_shortened(key, times)}]"
        letter = f"CASE WHEN {run}[1] = 'O' AND contains({base}, 'U') THEN 'U' ELSE {run}[1] END"
        tries.append(f"CASE WHEN {run} <> '' AND contains({base}, {letter}) THEN regexp_replace({base}, ({letter}) || '+', repeat({letter}, length({run})), 'g') END")
    return f"coalesce({', '.join(tries)})"


def sql_by_letters(core: str) -> str:
    for group, written in LETTERS:
        core = f"replace({core}, '{group}', '{written}')"
    return core


def sql_map() -> str:
    return "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in WRITTEN.items()) + "}"
