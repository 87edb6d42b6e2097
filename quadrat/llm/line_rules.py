"""Line-first cleaning, in DataFrame functions only.

Each line of a text is judged alone: too many symbols, navigation (menu separators or a row of very short
entries), boilerplate phrases, or a fragment that is short and ends without punctuation. Failing lines go,
blank lines and all others stay. A text that loses more than half of its words, or that fails the base counts,
is rejected. All work is inside the row, so nothing is shuffled and no source or copy can be hot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import SPACES, split_words

# Phrases of lines that are not prose of the page.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
    "accept cookies", "skip to content", "back to top", "click here", "read more", "sign up for", "log in to",
    "subscribe to our", "share this", "enable javascript", "powered by", "copyright ©", "© copyright",
    "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
)
SYMBOLS = "#*$%&|<>"
MENU_MARKS = ("|", "»", "›", "•", "·", ">")
END_MARKS = ".!?…。！？:;\"'”’»)]"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_menu_percent: int = 20
    fragment_words: int = 8
    boilerplate_words: int = 30
    max_lost_percent: int = 50


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `words`: the words inside 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash. They are sorted only in texts where a hash repeats."""
    size = F.size("words")
    word = lambda i: F.get(F.col("words"), i)
    windows = F.transform("words", lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    df = df.withColumn("__h", F.slice(windows, F.lit(1), F.greatest(size - 2, F.lit(0))))
    ranked = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), ranked)).drop("__h")
    near = lambda i, step: F.get(F.col("__s"), i + step)["h"]
    twice = F.filter("__s", lambda x, i: F.coalesce(x["h"] == near(i, -1), F.lit(False))
                     | F.coalesce(x["h"] == near(i, 1), F.lit(False)))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__s")
    steps = F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), i + 1) - p, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0))).drop("__p")


def _fails(line: Column, words: Column, rules: LineRules, symbols: Column, marks: Column) -> Column:
    """NULL for a line to keep, else the rule it fails. `symbols` and `marks` tell if the text has any."""
    size = F.size(words)
    in_line = F.char_length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    menu = F.size(F.filter(words, lambda w: w.isin(*MENU_MARKS))) * 100 > size * rules.max_menu_percent
    phrase = F.lower(line).rlike("|".join(BOILERPLATE))
    last = F.right(F.element_at(words, -1), F.lit(1))
    return (
        F.when(size == 0, None)
        .when(marks & menu, "navigation")
        .when(symbols & (in_line * 100 > F.char_length(line) * rules.max_symbol_percent), "symbols")
        .when((size <= rules.boilerplate_words) & phrase, "boilerplate")
        .when((size <= rules.fragment_words) & ~F.lit(END_MARKS).contains(last), "punctuation")
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """`docs` plus base counts, `removed_lines`, `clean_text`, `kept_words`, base_failed and kept.

    Null is an empty text: no words, so it fails the base counts. Columns of `docs` named like a result are
    replaced, all others pass through. `text` itself is left as it is."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text",
            "kept_words", "removed_lines", "words", "lines"]
    df = docs.drop(*[c for c in docs.columns if c.lower() in made])
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), split_words(x).alias("words")))
    df = df.withColumn("lines", lines)
    df = df.withColumns({
        "words": F.flatten(F.transform("lines", lambda x: x["words"])),
        "__f": F.transform(F.filter("lines", lambda x: F.size(x["words"]) > 0), lambda x: x["line"]),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "__m": text.rlike("[" + "".join(MENU_MARKS) + "]"),
    })
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("__f") - F.size(F.array_distinct("__f"))).cast("long"),
    }).drop("__f")
    df = _repeat_words(df).drop("words")
    judged = lambda x: F.struct(
        x["line"].alias("line"), F.size(x["words"]).alias("words"),
        _fails(x["line"], x["words"], rules, F.col("n_symbols") > 0, F.col("__m")).alias("rule"))
    df = df.withColumn("lines", F.transform("lines", judged)).drop("__m")
    keeps = F.filter("lines", lambda x: x["rule"].isNull())
    df = df.withColumns({
        "clean_text": F.array_join(F.transform(keeps, lambda x: x["line"]), "\n"),
        "removed_lines": F.filter("lines", lambda x: x["rule"].isNotNull()),
        "kept_words": F.aggregate(keeps, F.lit(0).cast("long"), lambda a, x: a + x["words"]),
    }).drop("lines")
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    lost = (F.col("n_words") - F.col("kept_words")) * 100 > F.col("n_words") * rules.max_lost_percent
    df = df.withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & ~lost)
