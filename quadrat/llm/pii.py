"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans of four kinds, which may overlap: the exact base patterns, and wider forms
(spelled-out or bracketed addresses, defanged or hexadecimal IPs, oddly separated card and phone numbers).
Each candidate gets yes/no features of its format and of the text around it. Boosted trees score the features;
a threshold for each kind, set on held-out rows for a wanted precision, selects spans. Base spans that pass their
check always stay; the trees add others.

No span is labelled by hand, so labels are weak: base spans that pass their check are positive, and so are copies
of them with the deciding mark hidden if a cue word or brackets stand with them; hidden copies without a cue,
and candidates that touch no valid base span, are negative. The trees see counts of feature patterns over all
rows, at most 4 * 2**12 of them whatever the input, and become CASE expressions on each candidate, so a text is
scored where it lies: nothing but pattern counts is shuffled."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns, written so that each run of characters is tried once. After a match \\G lets
# the next one start where it ended.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    CARD: r"[0-9](?:[ -]?[0-9]){13,}+",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
# The wider forms.
WIDE = (
    (EMAIL, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64} ?(?:\[at\]|\(at\)|\{at\}| at |@) ?[a-z0-9-]{2,63}"
            r"(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[a-z]{2,63}){1,4}+"),
    (IP, r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"),
    (IP, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9])"),
    (PHONE, r"(?<![0-9A-Za-z+.-])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
)
# The second half of the wide e-mail form and of the hexadecimal IP without digits; every match holds it.
SPELLED = r"(?i)(?:\[at\]|\(at\)|\{at\}| at |@) ?[a-z0-9-]{2,63} ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[a-z]{2}"
HEX = "[A-Fa-f]:[A-Fa-f]"
CUES = {
    EMAIL: "(?i)mail|contact|write|reach|schreib|kontakt|correo|courriel",
    IP: r"(?i)\bip\b|address|host|server|adresse|dirección",
    CARD: "(?i)card|visa|credit|debit|karte|carte|tarjeta",
    PHONE: "(?i)phone|tel|call|mobile|fax|cell|whatsapp|ruf|appel|llam",
}
AGAINST = r"(?i)version|licen[sc]e|isbn|order|invoice|serial|page|section|commit|hash|key|password|token|id[ :#=]*$"
BITS = ("mark", "luhn", "digits_7_9", "digits_10_13", "digits_14_19", "brackets", "separators", "cue", "against",
        "glued", "date", "valid")
BIT = {name: 1 << i for i, name in enumerate(BITS)}
SPAN = "array<struct<start:int,kind:int,end:int,txt:string,left:string,next:string,base:boolean>>"


@dataclass(frozen=True)
class Boosting:
    rounds: int = 24
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    min_weight: float = 4.0
    precision: float = 0.95


@dataclass
class SpanModel:
    """Trees as nested (bit, no, yes) or a number, and the least score of each kind (infinite: add none)."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    least: dict[int, float] = field(default_factory=dict)

    def score(self, pattern: int) -> float:
        return self.start + sum(_leaf(t, pattern) for t in self.trees)

    def column(self, pattern: Column) -> Column:
        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + _case(tree, pattern)
        return total


def _leaf(tree, pattern: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if pattern & tree[0] else tree[1]
    return tree


def _case(tree, pattern: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    bit, no, yes = tree
    return F.when(pattern.bitwiseAND(F.lit(bit)) != 0, _case(yes, pattern)).otherwise(_case(no, pattern))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    size = F.char_length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, i: a + weighed(i))
    return F.when(size.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: int, text: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return text.rlike(r"^(?:(?:^|\.)0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?=\.|$)){4}$")
    size = F.char_length(_digits(text))
    return size.between(10, 15) if kind == PHONE else size.between(14, 19) & _luhn(_digits(text))


def _located(text: Column, pattern: str, kind: int, base: bool, gate: Column) -> Column:
    """The matches of `pattern` as SPAN, in order; code points, end exclusive. Texts without `gate` have none."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    none = F.array().cast(SPAN)

    def add(a: Column, x: Column) -> Column:
        start = a["upto"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        valid = _valid(kind, x["m"]) if base else F.lit(False)
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("txt"),
                       F.right(x["g"], F.lit(30)).alias("left"), F.left(x["after"], F.lit(1)).alias("next"),
                       valid.alias("base"))
        more = F.struct(end.alias("upto"), F.concat(a["list"], F.array(one).cast(SPAN)).alias("list"))
        return F.when(x["m"].isNull(), a).otherwise(more)

    listed = F.aggregate(zipped, F.struct(F.lit(0).alias("upto"), none.alias("list")), add)["list"]
    return F.when(gate, listed).otherwise(none)


def _pattern(x: Column) -> Column:
    """The features of a candidate as bits, the kind above them."""
    size = F.char_length(_digits(x["txt"]))
    by_kind = lambda f: F.coalesce(*[F.when(x["kind"] == k, f(k)) for k in range(4)])
    marks = {EMAIL: "@[^ ]", IP: r"^[0-9.]+$", CARD: "^[0-9 -]+$", PHONE: r"^\+"}
    numeric = x["kind"] >= CARD
    is_on = {
        "mark": by_kind(lambda k: x["txt"].rlike(marks[k])),
        "luhn": numeric & _luhn(_digits(x["txt"])),
        "digits_7_9": numeric & size.between(7, 9),
        "digits_10_13": numeric & size.between(10, 13),
        "digits_14_19": numeric & size.between(14, 19),
        "brackets": x["txt"].rlike(r"[()\[\]]"),
        "separators": numeric & x["txt"].rlike("[ ./_-]"),
        "cue": by_kind(lambda k: x["left"].rlike(CUES[k])),
        "against": x["left"].rlike(AGAINST),
        "glued": x["left"].rlike("[A-Za-z0-9]$") | F.coalesce(x["next"].rlike("[A-Za-z0-9]"), F.lit(False)),
        "date": x["txt"].rlike(r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})"),
        "valid": by_kind(lambda k: _valid(k, x["txt"])) & (x["kind"] != EMAIL),
    }
    total = x["kind"] * (1 << len(BITS))
    for name, value in is_on.items():
        total = total + F.when(F.coalesce(value, F.lit(False)), F.lit(BIT[name])).otherwise(F.lit(0))
    return total


def candidates(docs: DataFrame) -> DataFrame:
    """`docs` with `__base`, the valid base spans, and `__more`, other candidates that touch none of them."""
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({
        "__at": text.contains("@"), "__digit": text.rlike("[0-9]"), "__plus": text.contains("+"),
        "__spelled": text.rlike(SPELLED), "__hex": text.rlike(HEX),
    })
    at, digit = F.col("__at"), F.col("__digit")
    gates = {EMAIL: at, IP: digit, CARD: digit, PHONE: digit & F.col("__plus")}
    wide = {EMAIL: F.col("__spelled"), IP: digit | F.col("__hex"), CARD: digit, PHONE: digit}
    df = df.withColumns({
        "__all": F.concat(*[_located(text, BASE[k], k, True, gates[k]) for k in range(4)]),
        "__wide": F.concat(*[_located(text, p, k, False, wide[k]) for k, p in WIDE]),
    }).drop("__at", "__digit", "__plus", "__spelled", "__hex")
    df = df.withColumn("__base", F.array_sort(F.filter("__all", lambda x: x["base"])))
    touches = lambda x: F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    same = lambda a, b: (a["kind"] == b["kind"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])
    df = df.withColumn("__failed", F.filter("__all", lambda x: ~x["base"]))
    new = F.filter("__wide", lambda x: ~F.exists("__failed", lambda b: same(x, b)))
    df = df.withColumn("__more", F.filter(F.concat("__failed", new), lambda x: ~touches(x)))
    described = lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), _pattern(x).alias("pattern"))
    return df.withColumns({
        "__base": F.transform("__base", described), "__more": F.transform("__more", described),
    }).drop("__all", "__wide", "__failed")


def fit(docs: DataFrame, how: Boosting = Boosting()) -> SpanModel:
    """Trees and thresholds from the pattern counts of all rows. Without positives the model adds nothing."""
    df = candidates(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    held = F.pmod(F.crc32(F.coalesce("doc_id", F.lit(""))), F.lit(5)) == 0
    one = lambda xs, label: F.transform(xs, lambda x: F.struct(x["pattern"].alias("p"), F.lit(label).alias("y")))
    rows = df.select(held.alias("held"), F.explode(F.concat(one("__base", 1), one("__more", 0))).alias("x"))
    counts = stored(rows.groupBy("held", "x.p", "x.y").agg(F.count("*").alias("n")), "span-patterns")
    table: dict[bool, dict[int, list[float]]] = {True: {}, False: {}}

    def add(part: bool, pattern: int, label: int, weight: float) -> None:
        table[part].setdefault(pattern, [0.0, 0.0])[label] += weight

    for held_out, pattern, label, n in counts.collect():
        add(held_out, pattern, label, n)
        if label:  # the same span with its mark hidden
            hidden = pattern & ~(BIT["mark"] | BIT["valid"])
            add(held_out, hidden, int(bool(hidden & (BIT["cue"] | BIT["brackets"]))), n)
            add(held_out, hidden | BIT["cue"], 1, n)
    train = table[False] or table[True]
    return _boost(train, table[True] or train, how)


def _boost(train: dict[int, list[float]], held: dict[int, list[float]], how: Boosting) -> SpanModel:
    pos, neg = sum(v[1] for v in train.values()), sum(v[0] for v in train.values())
    if not pos:
        return SpanModel(least=dict.fromkeys(range(4), math.inf))
    model = SpanModel(start=math.log((pos + 1) / (neg + 1)))
    bits = [1 << i for i in range(len(BITS) + 2)]
    raw = dict.fromkeys(train, model.start)
    for _ in range(how.rounds):
        grads = []
        for p, (n0, n1) in train.items():
            q = 1 / (1 + math.exp(-raw[p]))
            grads.append((p, n1 - (n0 + n1) * q, (n0 + n1) * q * (1 - q)))
        tree = _grow(grads, bits, how.depth, how)
        model.trees.append(tree)
        raw = {p: s + _leaf(tree, p) for p, s in raw.items()}
    for kind in range(4):
        ranked = sorted(((model.score(p), *v) for p, v in held.items() if p >> len(BITS) == kind), reverse=True)
        good = bad = 0.0
        model.least[kind] = math.inf
        for i, (score, n0, n1) in enumerate(ranked):
            good, bad = good + n1, bad + n0
            last = i + 1 == len(ranked) or ranked[i + 1][0] < score
            if last and good and n1 >= n0 and (good + 1) / (good + bad + 1) >= how.precision and score > 0:
                model.least[kind] = score
    return model


def _grow(grads: list[tuple[int, float, float]], bits: list[int], depth: int, how: Boosting):
    total_g, total_h = sum(g for _, g, _ in grads), sum(h for _, _, h in grads)
    gain = lambda g, h: g * g / (h + how.l2)
    best = (1e-9, None)
    for bit in bits if depth else []:
        g = sum(g for p, g, _ in grads if p & bit)
        h = sum(h for p, _, h in grads if p & bit)
        if min(h, total_h - h) * 4 >= how.min_weight / 4:
            best = max(best, (gain(g, h) + gain(total_g - g, total_h - h) - gain(total_g, total_h), bit),
                       key=lambda x: x[0])
    if best[1] is None:
        return how.rate * total_g / (total_h + how.l2)
    parts = [[x for x in grads if bool(x[0] & best[1]) == yes] for yes in (False, True)]
    return (best[1], _grow(parts[0], bits, depth - 1, how), _grow(parts[1], bits, depth - 1, how))


def find_spans(docs: DataFrame, model: SpanModel | None = None, how: Boosting = Boosting()) -> DataFrame:
    """`docs` with `base_spans` and `spans`: arrays of (start, kind, end), by start and then kind.

    Fits on `docs` when no model is given. Null texts have none. Base spans of different kinds may overlap; an
    added span touches neither a base span nor an added one before it."""
    model = model or fit(docs, how)
    df = candidates(docs.drop("__base", "__more", "base_spans", "spans"))
    plain = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    passes = lambda x: F.coalesce(*[
        F.when(x["kind"] == k, model.column(x["pattern"]) >= F.lit(v)) for k, v in sorted(model.least.items())
        if v != math.inf], F.lit(False))
    added = F.array_sort(F.transform(F.filter("__more", passes), plain))
    apart = F.aggregate(added, F.array().cast("array<struct<start:int,kind:int,end:int>>"), lambda a, x: F.when(
        F.coalesce(F.try_element_at(a, F.lit(-1))["end"] > x["start"], F.lit(False)), a).otherwise(F.concat(a, F.array(x))))
    base = F.transform("__base", plain)
    return df.withColumns({"base_spans": base, "spans": F.array_sort(F.concat(base, apart))}).drop("__base", "__more")


def span_text(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets and n_chars, if there, counted anew.

    The other columns pass through as they are, whatever their names. Overlapping spans become one, named after the first."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = find_spans(rows, model or fit(docs))
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)

    def step(a: Column, x: Column) -> Column:
        ahead = F.substring("text", a["upto"] + 1, x["start"] - a["upto"])
        more = F.struct(x["end"].alias("upto"), F.concat(a["out"], ahead, name(x["kind"])).alias("out"))
        longer = F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), a["out"].alias("out"))
        return F.when(x["start"] < a["upto"], longer).otherwise(more)

    done = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit("").alias("out")), step,
                       lambda a: F.concat(a["out"], F.substring("text", a["upto"] + 1, F.char_length("text"))))
    changed = F.size("spans") > 0
    row = F.col("row").withField("text", F.when(changed, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.char_length(done).cast(kind)).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")
