"""Emphasis of dialogue: which one or two words of a sentence are set in bold, as one projection.

Words are scored by a literal map of stress tiers; the best ones of a sentence are found by
ordering its scored words. Nothing is shuffled and no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by the stress that they carry, strongest first.
TIERS = {
    50: "aslo mutlaqo emas aslida".split(),
    40: "albatta juda eng faqat nahotki darhol tezroq aniq haqiqatan shunchaki qattiq butunlay mutlaq aynan".split(),
    30: "to'xta to'xtang qara qarang qoch qoching yordam tingla tinglang eshit eshiting ketdik tashla tashlang ehtiyot qutqar berkit".split(),
    25: "shart kerak lozim bilmayman bilolmayman qilolmayman qilolmaysan chidolmayman bo'lmaydi yetadi yetarli tushundim tushunmaysan to'xtatolmayman ishonolmayman".split(),
    20: "piter parker jonni doom dum mey ueyn oktavius spidey o'rgimchak betmen xalk hulk stark jona jeymson doktor kapitan".split(),
}
UNSTRESSED = "va ham bu u bilan uchun deb esa bir oq yoq shu o'sha mana ana men sen biz siz ular".split()
PHRASES = ("hech qachon", "hech kim", "hech narsa", "hech qayerda", "hech qanday", "mumkin emas", "ehtiyot bo'l", "ehtiyot bo'ling")
URGENT = "qoch yordam to'xta tashla".split()
STRESSED_ENDINGS = ("olmayman", "olmaysan", "olmadi")
# Stressed words of the source language and what they are in the target language.
BRIDGES = {
    "never": ["hech qachon", "aslo"], "no": ["yo'q", "emas"], "not": ["emas", "bo'lmaydi"], "must": ["shart", "kerak"], "will": ["albatta"],
    "really": ["haqiqatan", "nahotki", "juda"], "stop": ["to'xta", "to'xtang"], "look": ["qara", "qarang"], "always": ["har doim"],
    "why": ["nega", "nimaga"], "who": ["kim"], "what": ["nima"], "how": ["qanday"], "help": ["yordam"], "peter": ["piter"], "parker": ["parker"],
    "doom": ["dum", "doom"], "danger": ["xavf", "xavfli"],
}
GLUE = ("i", "a", "an", "the", "in", "on", "at")

# Letters, bold text, a word with marks around it, marks that open and close.
LETTER = "\\p{L}\\p{N}_"
BOLD = "\\*\\*[^*\\s].*?\\*\\*"
BOLD_INSIDE = "\\*\\*([^*]+)\\*\\*"
WORD = f"^([^{LETTER}'’ʼʻ`]*)([{LETTER}'’ʼʻ`-]+)([^{LETTER}'’ʼʻ`]*)$"
OPENERS, CLOSERS = "^([¿¡\"'«(„]*)", "([.,!?:;…\")»”]*)$"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+\\z", "")


def bare(word: Column) -> Column:
    """A word without marks, in small letters."""
    return F.lower(F.regexp_replace(word, f"[^{LETTER}'-]+", ""))


def bold_word(word: Column) -> Column:
    """A word in bold, marks around it left outside."""
    framed = F.when(word.rlike(WORD), F.regexp_replace(word, WORD, "$1**$2**$3")).otherwise(F.concat(F.lit("**"), word, F.lit("**")))
    return F.when(word.startswith("**") & word.endswith("**"), word).otherwise(framed)


def _with_bold(words: Column, first: Column, count: Column, second: Column) -> Column:
    """The words as a text: ``count`` of them from ``first`` in bold together, and the one at ``second``."""

    def each(word: Column, i: Column) -> Column:
        opened = F.regexp_replace(word, OPENERS, "$1**")
        closed = F.regexp_replace(word, CLOSERS, "**$1")
        alone = (count == 1) & (i == first) | (i == second)
        return F.when(alone, bold_word(word)).when((count > 1) & (i == first), opened).when((count > 1) & (i == first + count - 1), closed).otherwise(word)

    return F.array_join(F.transform(words, each), " ")


def _places(cleaned: Column, wanted: Column) -> Column:
    """For each of ``wanted`` (words joined by a space): the first word it starts at among the cleaned ones, or -1."""
    joined = F.concat(F.lit(" "), F.array_join(cleaned, " "), F.lit(" "))

    def place(x: Column) -> Column:
        at = F.position(F.concat(F.lit(" "), x, F.lit(" ")), joined)
        before = F.substr(joined, F.lit(1), at)
        return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).otherwise(-1)

    return F.transform(wanted, place)


def _scores(words: Column, cleaned: Column) -> Column:
    """(score, -place) of the words that carry stress, strongest and first of equals first."""
    table = F.create_map(*[F.lit(x) for score, tier in TIERS.items() for word in tier for x in (word, score)])

    def score(word: Column, i: Column) -> Column:
        own = F.get(cleaned, i)
        listed = table[own]
        ending = own.endswith(STRESSED_ENDINGS[0])
        for x in STRESSED_ENDINGS[1:]:
            ending = ending | own.endswith(x)
        found = F.coalesce(F.when(listed >= 25, listed), F.when(ending, 25), listed, F.when(word.contains("!") & (F.length(own) >= 3), 15))
        return F.when((own != "") & ~own.isin(*UNSTRESSED), found)

    scored = F.transform(words, lambda w, i: F.struct(score(w, i).alias("score"), (-i).alias("neg")))
    return F.sort_array(F.filter(scored, lambda x: x["score"].isNotNull()), asc=False)


def emphasised(sentence: Column) -> Column:
    """A sentence without bold, with its one or two most stressed words in bold.

    Of one or two words only an urgent call is set so. A listed phrase goes before single words; a
    second word needs eight words in all, a score of 25 and a distance of two. Without a stressed
    word, the last word of weight of an exclamation is taken."""

    def of_words(words: Column) -> Column:
        return _bind(F.struct(words.alias("w"), F.transform(words, bare).alias("c")), lambda x: told(x["w"], x["c"]))

    def told(words: Column, cleaned: Column) -> Column:
        n, none = F.size(words), F.lit(-1)
        calls = F.transform(words, lambda w, i: F.when(F.get(cleaned, i).isin(*URGENT) & w.contains("!"), i))
        call = F.coalesce(F.get(F.array_compact(calls), F.lit(0)), none)
        found = F.get(F.filter(_places(cleaned, F.array(*map(F.lit, PHRASES))), lambda p: p >= 0), F.lit(0))
        weighty = F.transform(cleaned, lambda c, i: F.when((F.length(c) >= 3) & ~c.isin(*UNSTRESSED), i))
        last = F.when(F.array_join(words, " ").contains("!"), F.array_max(weighty))

        def chosen(scores: Column) -> Column:
            best, next_one = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
            also = (n >= 8) & (next_one["score"] >= 25) & (F.abs(next_one["neg"] - best["neg"]) >= 2)
            first = F.coalesce(-best["neg"], last, none)
            return _with_bold(words, first, F.lit(1), F.coalesce(F.when(also, -next_one["neg"]), none))

        long = F.when(found.isNotNull(), _with_bold(words, found, F.lit(2), none)).otherwise(_bind(_scores(words, cleaned), chosen))
        return F.when(n <= 2, F.when(call >= 0, _with_bold(words, call, F.lit(1), none)).otherwise(sentence)).otherwise(long)

    return _bind(F.split(sentence, "\\s+", -1), of_words)


def _unbolded(text: Column) -> Column:
    """The text without its bold marks if all, or at least 80 percent, of it is bold."""
    inner = stripped(F.substr(text, F.lit(3), F.greatest(F.length(text) - 4, F.lit(0))))
    around = text.startswith("**") & text.endswith("**") & ~inner.contains("**")
    words = F.split(text, "\\s+", -1)
    marked = F.size(F.filter(words, lambda w: w.contains("**")))
    mostly = (F.size(words) > 1) & (10 * marked >= 8 * F.size(words))
    return F.when(around | mostly, stripped(F.replace(text, F.lit("**"), F.lit("")))).otherwise(text)


def _stays(text: Column) -> Column:
    """Whether the bold that is there is sound: one to three words, at most 40 percent."""
    inside = F.regexp_extract_all(text, F.lit(BOLD_INSIDE))
    n = F.aggregate(inside, F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x, "\\s+", -1), lambda w: w != "")))
    return text.rlike(BOLD) & (n >= 1) & (n <= 3) & (10 * n <= 4 * F.size(F.split(text, "\\s+", -1)))


def _by_sentence(text: Column) -> Column:
    def line(x: Column) -> Column:
        ends = F.regexp_replace(x, "([.!?…])\\s+", "$1\u0001")
        sentences = F.filter(F.transform(F.split(ends, "\u0001", -1), stripped), lambda s: s != "")
        return F.array_join(F.transform(sentences, lambda s: F.when(s.rlike(BOLD), s).otherwise(emphasised(s))), " ")

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def emphasis(text: Column, source: Column | None = None) -> Column:
    """``text`` with emphasis: sound bold stays, a text wholly in bold loses its own, stress of the
    ``source`` is carried over where a bridge word is found, else each sentence is emphasised.

    A null text gives an empty one."""

    def told(t: Column) -> Column:
        tries = [F.when(_stays(t), t)]
        if source is not None:
            tries.append(projected(source, t))
        return F.when(t == "", "").otherwise(F.coalesce(*tries, _by_sentence(t)))

    return _bind(_unbolded(stripped(text)), told)


def stressed_words(source: Column) -> Column:
    """The words that a source text stresses: in bold first, then in capitals among small letters."""
    whole = F.coalesce(source, F.lit(""))
    bold = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(BOLD_INSIDE)), bare), lambda w: (w != "") & ~w.isin(*UNSTRESSED))
    capital = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(bare(w)) >= 2) & ~bare(w).isin(*GLUE)
    capitals = F.when(whole.rlike("\\p{Ll}"), F.transform(F.filter(F.split(whole, "\\s+", -1), capital), bare)).otherwise(F.array().cast("array<string>"))
    return F.concat(bold, capitals)


def projected(source: Column, text: Column) -> Column:
    """``text`` with the first word or pair in bold that stands for a stressed word of ``source``; else null."""
    bridges = F.create_map(*[x for word, to in BRIDGES.items() for x in (F.lit(word), F.array(*map(F.lit, to)))])
    wanted = F.flatten(F.transform(stressed_words(source), lambda w: F.coalesce(bridges[w], F.array(w))))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+", -1), lambda w: w != "")

    def told(x: Column) -> Column:
        at = F.transform(_places(x["cleaned"], x["wanted"]), lambda p, i: F.struct(p.alias("place"), F.size(F.split(F.get(x["wanted"], i), " ", -1)).alias("n")))
        hit = F.get(F.filter(at, lambda p: p["place"] >= 0), F.lit(0))
        return F.when(hit.isNotNull(), _with_bold(x["words"], hit["place"], hit["n"], F.lit(-1)))

    return _bind(F.struct(words.alias("words"), F.transform(words, bare).alias("cleaned"), wanted.alias("wanted")), told)
