"""Column builders over text: sentences, leaks, junk reasons, scores, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = "[.!?…]+"
#: The sentence splits in use; they differ on purpose.
SPLITS = {"end": SENTENCE_END, "end_colon": "[.!?…:]+", "after_clause": "(?<=[.!?…;])\\s+", "after_end": "(?<=[.!?…])\\s+", "dash": "[.!?…—/–]+"}
# Code points that stand for an apostrophe.
APOSTROPHES = "ʻʼ‘’`´ʹ′＇ˊ"


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def sentences(text: Column, split: str = "end") -> Column:
    """Pieces with a word character in them."""
    return F.filter(F.split(text, SPLITS[split]), lambda x: x.rlike("\\w"))


def drops_sentence(source: Column, target: Column) -> Column:
    n, m = (F.size(sentences(F.coalesce(t, F.lit("")))) for t in (source, target))
    return (n >= 2) & (m < n)


def letters_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", ""))


def untranslated(source: Column, target: Column) -> Column:
    """The target is blank, or the same letters and digits as the source (two at least)."""
    same = (letters_key(source) == letters_key(target)) & (F.length(letters_key(target)) >= 2)
    return (F.trim(F.coalesce(target, F.lit(""))) == "") | same


def plausible_word(word: Column) -> Column:
    """Could be a word: two different letters, a vowel, at most four consonants in a row."""
    w = F.regexp_replace(F.upper(word), "[^A-Z]+", "")
    vowels = F.length(F.regexp_replace(w, "[^AEIOUYaeiouy]+", ""))
    one = F.length(F.replace(F.lower(w), F.substring(F.lower(w), 1, 1), F.lit(""))) == 0
    return (F.length(w) >= 2) & ~one & (vowels > 0) & ~((F.length(w) > 6) & (100 * vowels < 12 * F.length(w))) & ~w.rlike("[B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]{5,}")


def junk_reason(text: Column, confidence: Column, sounds: list[str], watermarks: list[str], vocabulary: list[str], on_paper: Column | None = None, sounding=None) -> Column:
    """Why a line is no dialogue; the first rule that matches, else 'valid'.

    ``sounding`` (see ``similarity.sounding``) judges words that are only like sounds, too."""
    t = F.trim(text)
    words = F.regexp_extract_all(F.upper(t), F.lit("([A-Z']+)"))
    bare = F.filter(F.transform(words, lambda w: F.replace(w, F.lit("'"), F.lit(""))), lambda w: w != "")
    letters, alnum = (F.length(F.regexp_replace(t, p, "")) for p in ("[^A-Za-z]+", "[^A-Za-z0-9]+"))
    symbols = F.length(F.regexp_replace(t, "[A-Za-z0-9\\s]+", ""))
    tokens = F.filter(F.split(t, "\\s+"), lambda w: w != "")
    single = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    marks = _any(*[F.upper(t).contains(w.upper()) for w in watermarks])
    sure = (confidence >= 0.25) if on_paper is None else (confidence >= 0.25) | on_paper
    known = F.exists(bare, lambda w: w.isin(*vocabulary) | (sure & plausible_word(w)) | w.isin("A", "I"))
    loose = sounding(F.filter(F.split(F.regexp_replace(F.upper(t), "[^A-Z0-9\\s]", " "), "\\s+"), lambda w: w != "")) if sounding else None
    first = F.when(t == "", "empty").when((F.size(bare) > 0) & F.forall(bare, lambda w: w.isin(*sounds)), "sfx").when(confidence < 0.12, "low_conf")
    if sounding:
        first = first.when(loose["all"], "sfx").when(loose["some"], "sfx_partial")
    return (
        first.when(marks, "watermark").when(letters < 2, "too few letters").when((alnum == 0) | (5 * symbols > 6 * alnum), "abnormal symbol ratio")
        .when((F.size(tokens) >= 3) & (5 * single >= 3 * F.size(tokens)), "fragmented tokens").when(~known, "no valid word").otherwise("valid")
    )


def residue_tokens(text: Column, leaks: list[str], permitted: list[str], suffixes: list[str]) -> Column:
    """Distinct tokens that are foreign words, also with a suffix of the target language, in order."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z'-]+)")), lambda w: F.upper(F.trim(w)))

    def leaks_through(w: Column) -> Column:
        tail = _any(*[F.endswith(w, F.lit(s)) & (F.length(w) > len(s) + 2) & F.substr(w, F.lit(1), F.length(w) - len(s)).isin(*leaks) for s in suffixes])
        return (F.length(w) >= 2) & ~w.isin(*(permitted or [""])) & (w.isin(*leaks) | tail)

    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("(XNAME_[A-Za-z0-9_]+_X)")), F.filter(words, leaks_through)))


def review_reason(source: Column, target: Column, failed: Column | None = None, residue: Column | None = None) -> Column:
    """Why a translation needs review; the first rule that matches, else null."""
    s, t = (F.trim(F.coalesce(x, F.lit(""))) for x in (source, target))
    key_s, key_t = (F.upper(F.regexp_replace(x, "[^A-Za-z0-9]+", "")) for x in (s, t))
    out = F.when(failed, "error") if failed is not None else F.when(F.lit(False), "error")
    out = out.when((key_s != "") & (key_t == ""), "empty").when((key_t != "") & (key_s == key_t), "identical")
    if residue is not None:
        out = out.when(F.size(residue) > 0, "residue")
    return out.when(drops_sentence(s, t), "sentence_drop")


#: Borders of a word, as any regular-expression engine reads them.
WORD_START, WORD_END = "(^|[^\\p{L}\\p{N}_])", "([^\\p{L}\\p{N}_]|$)"


def naturalness(text: Column, stiff: list[str], endings: list[str], idioms: list[str], pronouns: list[str] | None = None) -> Column:
    """A score in hundredths: 100, less 25 for each stiff pattern and 20 for a repeated pronoun, and
    15 more for each natural ending, 10 for each idiom. A blank text scores 0."""
    low = F.lower(F.trim(text))
    score = F.lit(100)
    for patterns, points in ((stiff, -25), (endings, 15), (idioms, 10)):
        for p in patterns:
            score = score + F.when(low.rlike(p), points).otherwise(0)
    if pronouns:
        twice = [low.rlike(f"(?s){WORD_START}{p}[^\\p{{L}}\\p{{N}}_](.*[^\\p{{L}}\\p{{N}}_])?{p}{WORD_END}") for p in pronouns]
        score = score - F.when(_any(*twice), 20).otherwise(0)
    return F.when(F.coalesce(low, F.lit("")) == "", 0).otherwise(score)


def first_group(text: Column, groups: dict[str, list[str]]) -> Column:
    """The first group of which the text contains a key."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for name, keys in groups.items():
        out = out.when(_any(*[low.contains(k) for k in keys]), name)
    return out


def plain_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def comic_case(text: Column) -> Column:
    """Upper case without emphasis marks, one sentence a line, single spaces and marks."""
    t = F.regexp_replace(plain_apostrophes(text), "\\*+", "")
    t = F.regexp_replace(F.regexp_replace(t, "!{2,}", "!"), "[ \\t]+", " ")
    return F.upper(F.trim(F.regexp_replace(t, "(?<=[.!?…])\\s+", "\n")))


def sentence_lines(text: Column) -> Column:
    """One sentence a line; initials and short titles do not end one."""
    return F.regexp_replace(text, "(?<![A-Z]\\.)(?<!\\b(?:Dr|Mr|Ms|vs)\\.)(?<!\\b(?:Mrs)\\.)(?<!\\bProf\\.)(?<=[.!?…])[ \\t]+", "\n")


def unquoted(text: Column) -> Column:
    """Without dialogue quotes; apostrophes inside of words stay."""
    t = F.regexp_replace(text, '["“”„«»]', "")
    return F.regexp_replace(F.regexp_replace(t, "(?m)(?<![A-Za-z])['‘’]|['‘’](?![A-Za-z])", ""), "[ \\t]{2,}", " ")


def line_key(text: Column) -> Column:
    """A key under which spoken lines count as the same."""
    t = F.lower(plain_apostrophes(text))
    for pattern, plain in (("n't\\b", " not"), ("'re\\b", " are"), ("'m\\b", " am"), ("'ll\\b", " will"), ("'ve\\b", " have"), ("[^a-z0-9 ]+", " "), (" +", " ")):
        t = F.regexp_replace(t, pattern, plain)
    return F.trim(t)


def continues(previous: Column, text: Column, glue: list[str]) -> Column:
    """Whether a line goes on from the one before: open end there, or a lower-case or glue start here."""
    start = F.regexp_extract(F.trim(text), "^([A-Za-z']+)", 1)
    return previous.isNotNull() & (F.trim(previous).rlike("(\\.\\.\\.|…|-|—|,)$") | F.trim(text).rlike("^[a-z]") | F.lower(start).isin(*glue))


def restored_end(source: Column, target: Column) -> Column:
    """The target with the source's leading dots and closing mark."""
    lead = F.regexp_extract(source, "^\\s*(\\.{2,}|…|-+)", 1)
    mark = F.regexp_extract(F.trim(source), "([.!?…]+)$", 1)
    t = F.when((lead != "") & ~F.startswith(target, lead), F.concat(lead, target)).otherwise(target)
    return F.when((mark != "") & ~F.trim(t).rlike("[.!?…]$"), F.concat(F.rtrim(t), mark)).otherwise(t)


def version_numbers(version: Column) -> Column:
    """The numbers of a version, which compare in order."""
    return F.transform(F.regexp_extract_all(version, F.lit("(\\d+)")), lambda x: x.cast("int"))


def clean_json(text: Column) -> Column:
    """The JSON object or array inside of a reply: no fences, no commas before a closing bracket."""
    t = F.regexp_replace(text, "(?s)^.*?```(?:json)?\\s*|\\s*```.*$", "")
    t = F.when(t == "", text).otherwise(t)
    t = F.regexp_extract(t, "(?s)([\\[{].*[\\]}])", 1)
    return F.regexp_replace(t, ",\\s*([\\]}])", "$1")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens of two token arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{M}\\p{N}]+)")))


def persona_line(text: Column, exact: Column, rules: list[tuple[str, str]], loud: bool = False) -> Column:
    """A line in a character's voice: a known line as it is (by its text, then by its key), else the
    phrase rules in order; a loud voice ends on an exclamation mark."""
    known = F.coalesce(F.try_element_at(exact, F.trim(text)), F.try_element_at(exact, line_key(text)))
    out = text
    for pattern, plain in rules:
        out = F.regexp_replace(out, pattern, plain)
    return F.coalesce(known, F.regexp_replace(out, "\\.\\s*$", "!") if loud else out)


def facts(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The facts whose patterns a text matches, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(fact)) for p, fact in rules]))


def json_strings(text: Column, key: str) -> Column:
    """The string values of ``key`` in a broken JSON text, in order.

    The characters of a string are taken possessively: there is one way to read them, and a regular
    expression that may go back keeps a frame of the stack for each."""
    return F.regexp_extract_all(text, F.lit(f'"{key}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*+)"'))


def numbered(texts: Column) -> Column:
    """An array as numbered lines."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def agreement(own: Column, other: Column, source: Column, negative_source: str, negative: str) -> Column:
    """Whether two translations say the same: not of opposite polarity where the other strays from
    the source, and with a seventh of the smaller vocabulary shared."""
    no_s, no_a, no_b = source.rlike(negative_source), own.rlike(negative), other.rlike(negative)
    a, b = tokens(own), tokens(other)
    shared = 100 * F.size(F.array_intersect(a, b)) >= 15 * F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~((no_a != no_b) & (no_b != no_s)) & shared


def plain_entities(text: Column) -> Column:
    """The usual character references as characters, ampersands last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text
