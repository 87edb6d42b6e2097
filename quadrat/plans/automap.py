"""Column auto-mapping: score every header against every target term, decide, override, fall back.

The data is read once for the profile (`stats.column_profile`). Everything after works on header rows
(dataset, column) and so also serves a whole catalogue of datasets at once. Terms come as a constant
array that each header row explodes; there is no join of headers and terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.text import FOLD_FROM, FOLD_TO, any_of, is_blank, match_form
from quadrat.lookups import core_terms
from quadrat.operators.numbering import first_per_key, last_per_key
from quadrat.session import ensure_checkpoint_dir

# Terms with special rules.
MANUAL_TERMS = ("modified", "license", "language")
TEMPORAL_TERMS = ("eventDate", "year", "month", "day", "modified", "dateIdentified")
NUMERIC_TERMS = ("decimalLatitude", "decimalLongitude", "individualCount", "year", "month", "day")
VERBATIM_OF = {"decimalLatitude": "verbatimLatitude", "decimalLongitude": "verbatimLongitude", "eventDate": "verbatimEventDate"}
# Header words of identifiers and of what they identify.
ID_WORDS = ("id", "identifier", "identificador", "codigo", "cod")
ID_ENTITIES = {
    "occurrence": ("occurrence", "ocorrencia"),
    "location": ("location", "localidade", "local", "site", "sitio", "station", "estacao", "plot", "parcela", "point", "ponto",
                 "trap", "armadilha", "road", "rodovia", "transect", "transecto", "trail", "trilha"),
    "event": ("event", "evento", "survey", "campanha", "sampling", "amostragem", "visit", "visita"),
    "person": ("identified", "determiner", "determinador", "collector", "coletor", "observer", "observador", "person", "pessoa"),
    "other": ("taxon", "species", "especie", "study", "estudo", "reference", "referencia", "ref", "project", "projeto", "dataset",
              "individual", "organism", "animal", "tag", "record", "registro", "photo", "foto"),
}
ID_TERMS = {"occurrenceID": "occurrence", "locationID": "location", "eventID": "event", "parentEventID": "event", "identifiedByID": "person"}
ID_ACCEPTING = (*ID_TERMS, "catalogNumber", "recordNumber", "associatedMedia", "associatedReferences")


@dataclass(frozen=True)
class Options:
    auto: float = 0.90
    suggest: float = 0.75
    veto: float = 0.30
    overlap_value: float = 0.80
    gap: float = 0.10
    prune: float = 0.45


def overlap_tokens(value: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(match_form(spaced), " "), lambda x: x != ""))


def token_overlap(column_tokens: Column, term_tokens: Column) -> Column:
    """struct(score, exact, substring) of two token lists."""
    exact = F.size(F.array_intersect(column_tokens, term_tokens))
    near = F.size(F.filter(column_tokens, lambda c: ~F.array_contains(term_tokens, c) & F.exists(
        term_tokens, lambda t: (F.length(c) >= 3) & (F.length(t) >= 3) & (t.contains(c) | c.contains(t)))))
    union = F.size(F.array_union(column_tokens, term_tokens))
    raw = 0.55 + 0.25 * (exact + near) / F.nullif(union, F.lit(0)) + 0.10 * exact - 0.10 * near
    score = F.when(exact + near > 0, F.least(F.lit(0.80), F.greatest(F.lit(0.0), raw))).otherwise(0.0)
    return F.struct(score.alias("score"), exact.alias("exact"), near.alias("substring"))


def text_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    share = 1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))
    return F.when((a == "") | (b == ""), 0.30).otherwise(F.least(F.lit(0.60), F.greatest(F.lit(0.30), 0.30 + 0.30 * share)))


def _entities(tokens: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(any_of([F.array_contains(tokens, w) for w in words]), F.lit(e)) for e, words in ID_ENTITIES.items()]))


def penalties(form: Column, tokens: Column, term: Column) -> Column:
    """Sum of header-context penalties, at least -0.5."""
    is_id = any_of([F.array_contains(tokens, w) for w in ID_WORDS])
    bare = F.size(F.array_except(tokens, F.array(*[F.lit(w) for w in ID_WORDS]))) == 0
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in ID_TERMS.items() for x in kv]), term)
    entities = _entities(tokens)
    foreign = own.isNotNull() & ((bare & (own != "occurrence")) | ((F.size(entities) > 0) & ~F.array_contains(entities, own)))
    coordinate, temporal = term.isin("decimalLatitude", "decimalLongitude"), term.isin(*TEMPORAL_TERMS)
    rules = [
        (is_id & (F.coalesce(foreign, F.lit(False)) | ~term.isin(*ID_ACCEPTING)), -0.30),
        (coordinate & form.rlike(r"\b(temp|temperatura)\b"), -0.30),
        (coordinate & form.rlike(r"\b(depth|profund|altura)\b"), -0.30),
        (temporal & form.rlike(r"\b(count|numero|qtd|quantidade)\b"), -0.20),
        (form.rlike(r"^((campo|col|column|field|var)[ _-]*[0-9]+|col_[a-z0-9]+)$"), -0.10),
    ]
    total = sum((F.when(c, v).otherwise(0.0) for c, v in rules), F.lit(0.0))
    return F.greatest(F.lit(-0.5), total)


def _term_rows(terms: list[str]) -> Column:
    import re

    def tokens(t: str) -> list[str]:
        spaced = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", t))
        return list(dict.fromkeys(re.findall("[a-z0-9]+", spaced.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)))))

    return F.array(*[
        F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("form"), F.array(*[F.lit(x) for x in tokens(t)]).alias("tokens")) for t in terms
    ])


def _value_score(term: Column, name_score: Column, options: Options) -> Column:
    """struct(score, reason, compatible): how well the column's values suit the term."""
    ratio = (
        F.when(term == "decimalLatitude", F.col("latitude")).when(term == "decimalLongitude", F.col("longitude"))
        .when(term == "scientificName", F.col("name")).when(term == "individualCount", F.col("count"))
        .when(term == "occurrenceStatus", F.when((name_score < options.auto) | (F.col("status") >= 0.80), F.col("status")))
        .when(term == "basisOfRecord", F.when((name_score < options.auto) | (F.col("basis") >= 0.80), F.col("basis")))
    )
    compatible = (
        F.when(term.isin("decimalLatitude", "decimalLongitude", "individualCount"), F.col("numeric") >= 0.60)
        .when(term == "scientificName", F.col("name") >= 0.50).otherwise(F.lit(True))
    )
    score = F.when(F.col("filled") == 0, 0.0).when(name_score < options.prune, 0.0).when(ratio.isNull(), 0.80).when(
        ratio < options.veto, 0.0).otherwise(ratio)
    reason = (
        F.when(F.col("filled") == 0, "empty_column").when(name_score < options.prune, "low_name_confidence").when(ratio.isNull(), "neutral_no_validator")
        .when(ratio < options.veto, "veto_low_validation").when(ratio >= 0.80, "content_validated").otherwise("weak_content_validation")
    )
    return F.struct(score.alias("score"), reason.alias("reason"), ((F.col("filled") > 0) & compatible).alias("compatible"))


def candidates(profile: DataFrame, synonyms: DataFrame | None = None, terms: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """Scored (dataset, column, term) rows that survive pruning.

    profile: dataset plus the columns of `stats.column_profile`, optionally `date_share`. synonyms: term,
    synonym, score. A header that equals a term belongs to that term only."""
    wanted = [t for t in (terms or core_terms()) if t not in MANUAL_TERMS]
    heads = profile.withColumns({"form": match_form(F.col("column")), "tokens": overlap_tokens(F.col("column"))})
    if "date_share" not in heads.columns:
        heads = heads.withColumn("date_share", F.lit(0.0))
    rows = heads.withColumn("t", F.explode(_term_rows(wanted)))
    exact = F.col("form") == F.col("t.form")
    owner = F.array_contains(F.array(*[F.lit(t.lower()) for t in wanted]), F.col("form"))
    rows = rows.filter(exact | ~owner).withColumn("term", F.col("t.term"))
    if synonyms is not None:
        side = synonyms.select(F.col("term").alias("__t"), match_form("synonym").alias("__s"), F.col("score").alias("__score")).groupBy("__t", "__s").agg(
            F.max("__score").alias("__score"))
        rows = rows.join(side, (F.col("term") == F.col("__t")) & (F.col("form") == F.col("__s")), "left").drop("__t", "__s")
    else:
        rows = rows.withColumn("__score", F.lit(None).cast("double"))
    rows = rows.withColumns({"o": token_overlap(F.col("tokens"), F.col("t.tokens")), "exact": exact})
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in ID_TERMS.items() for x in kv]), F.col("term"))
    is_id = any_of([F.array_contains("tokens", w) for w in ID_WORDS])
    bonus = F.when(is_id & (F.size(_entities(F.col("tokens"))) == 1) & (F.get(_entities(F.col("tokens")), F.lit(0)) == own), 0.10).otherwise(0.0)
    synonym = F.least(F.lit(0.98), F.greatest(F.lit(0.90), F.col("__score")))
    name = (
        F.when(F.col("exact"), F.lit(1.0)).when(F.col("__score").isNotNull(), synonym)
        .when(F.col("o.score") >= 0.40, F.col("o.score") + bonus).otherwise(text_similarity(F.col("form"), F.col("t.form")))
    )
    reason = (
        F.when(F.col("exact"), "exact_match").when(F.col("__score").isNotNull(), "known_synonym")
        .when(F.col("o.score") >= 0.40, "token_overlap").otherwise("text_similarity")
    )
    rows = rows.withColumns({"name_score": name, "name_reason": reason})
    temporal = F.col("term").isin(*TEMPORAL_TERMS)
    rescue = temporal & ~F.col("exact") & (F.col("term") == "eventDate") & (F.col("name_score") >= options.prune) & (F.col("date_share") >= 0.90)
    rows = rows.withColumn("rescue", F.coalesce(rescue, F.lit(False))).filter(~temporal | F.col("exact") | F.col("rescue"))
    rows = rows.filter(F.col("name_reason").isin("exact_match", "known_synonym") | (F.col("name_score") >= options.prune))
    dated = F.struct(F.col("date_share").alias("score"), F.lit("content_validated").alias("reason"), F.lit(True).alias("compatible"))
    rows = rows.withColumn("v", F.when(F.col("rescue"), dated).otherwise(_value_score(F.col("term"), F.col("name_score"), options)))
    weak = (F.col("name_reason") == "token_overlap") & (F.col("name_score") <= 0.70) & (F.col("v.score") < options.overlap_value)
    rows = rows.filter(~weak).withColumn("penalty", penalties(F.col("form"), F.col("tokens"), F.col("term")))
    veto = (
        F.when(F.col("v.reason") == "empty_column", "empty_column").when(F.col("v.reason") == "veto_low_validation", "low_validation")
        .when(~F.col("v.compatible") & F.col("term").isin(*NUMERIC_TERMS), "type_incompatible").otherwise("")
    )
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.col("name_score") + 0.5 * F.col("v.score") + F.col("penalty")))
    capped = F.when(F.col("rescue") | (F.length("form") == 1), F.least(base, F.lit(options.auto - 0.01))).otherwise(base)
    rows = rows.withColumn("veto", veto).withColumn("final_score", F.when(F.col("veto") != "", 0.0).otherwise(capped))
    expected = F.when(F.col("term").isin(*NUMERIC_TERMS), F.col("numeric")).when(F.col("term").startswith("verbatim"), 1 - F.col("numeric")).otherwise(0.5)
    return rows.select(
        "dataset", "column", "term", "name_score", F.col("v.score").alias("value_score"), "penalty", "veto", "final_score", "name_reason",
        F.col("v.compatible").alias("compatible"), F.size("tokens").alias("specificity"), F.col("o.exact").alias("exact_hits"),
        F.col("o.substring").alias("substring_hits"), "completeness", expected.alias("type_match"),
    )


RANK_ORDER = ("final_score", "value_score", "type_match", "completeness", "specificity", "exact_hits")


def rank_candidates(rows: DataFrame) -> DataFrame:
    """Adds `rank` per dataset and term. A dataset has as many rows here as it has headers."""
    best = Window.partitionBy("dataset", "term").orderBy(
        *[F.desc(c) for c in RANK_ORDER], "substring_hits", "column")
    return rows.withColumn("rank", F.row_number().over(best))


def much_fuller(big: Column, small: Column) -> Column:
    return F.coalesce((big >= 0.5) & (small < 0.5 * big), F.lit(False))


def decide(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """One decision per dataset and term: AUTO, SUGGESTED, AMBIGUOUS or MANUAL, then one term per column.

    Two close scores are ambiguous unless the first column is much fuller. `alternatives` holds the best
    three as JSON."""
    ranked = rank_candidates(rows)
    order = Window.partitionBy("dataset", "term").orderBy("rank")
    ranked = ranked.withColumns({"next_score": F.lead("final_score").over(order), "next_fill": F.lead("completeness").over(order)})
    top = F.when(F.col("rank") <= 3, F.struct("rank", "column", "final_score", "name_score", "value_score"))
    best = ranked.groupBy("dataset", "term").agg(
        F.min_by(F.struct(*[c for c in ranked.columns if c not in ("dataset", "term")]), "rank").alias("b"),
        F.to_json(F.sort_array(F.collect_list(top))).alias("alternatives"),
    ).select("dataset", "term", "b.*", "alternatives")
    score = F.col("final_score")
    tie = (score >= options.suggest) & (score - F.col("next_score") < options.gap - 1e-8) & ~much_fuller(F.col("completeness"), F.col("next_fill"))
    status = (
        F.when(F.coalesce(tie, F.lit(False)), "AMBIGUOUS").when((score >= options.auto) & F.col("compatible"), "AUTO")
        .when(score >= options.suggest, "SUGGESTED").otherwise("MANUAL")
    )
    chosen = best.withColumn("status", status)
    claim = Window.partitionBy("dataset", "column").orderBy(
        (~F.col("status").isin("AUTO", "SUGGESTED")).cast("int"), *[F.desc(c) for c in RANK_ORDER], "substring_hits", "term")
    chosen = chosen.withColumn("claim", F.row_number().over(claim))
    lost = F.col("status").isin("AUTO", "SUGGESTED") & (F.col("claim") > 1)
    applied = F.col("status").isin("AUTO", "SUGGESTED") & ~lost
    reason = (
        F.when(F.col("status") == "AMBIGUOUS", "ambiguity_detected").when(lost, "conflict_lost").when(F.col("veto") != "", "veto_hard")
        .when(F.col("status") == "MANUAL", "no_confident_match").otherwise(F.col("name_reason"))
    )
    return chosen.select(
        "dataset", "term", F.when(applied, F.col("column")).alias("column"), F.col("column").alias("candidate"), "name_score", "value_score", "final_score",
        F.when(lost, "MANUAL").otherwise(F.col("status")).alias("status"), reason.alias("reason"), applied.alias("applied"), "completeness", "alternatives",
    )


def visible_aliases(aliases: DataFrame, user: str, institution: str) -> DataFrame:
    """Best alias per header: own before institution before global, then confidence, review, recency, id.

    aliases: alias_id, scope, owner, column, term, confidence, reviewed, updated_at, active."""
    seen = aliases.filter("active").filter(
        (F.col("scope") == "global") | ((F.col("scope") == "user") & (F.col("owner") == user))
        | ((F.col("scope") == "institution") & (F.col("owner") == institution)))
    rank = F.when(F.col("scope") == "user", 3).when(F.col("scope") == "institution", 2).otherwise(1)
    keyed = seen.withColumn("header", match_form("column"))
    return last_per_key(keyed, ["header"], [rank, F.col("confidence"), F.col("reviewed"), F.col("updated_at"), F.col("alias_id")])


def override_with_aliases(decisions: DataFrame, profile: DataFrame, aliases: DataFrame, options: Options = Options()) -> DataFrame:
    """A learned header takes its term, unless the term already has a much fuller column."""
    heads = profile.select("dataset", "column", "completeness", match_form("column").alias("header"))
    hits = heads.join(aliases.select("header", "term", "confidence"), "header")
    hits = hits.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(options.suggest), F.col("confidence"))))
    best = last_per_key(hits.drop("header"), ["dataset", "term"], [F.col("confidence"), F.col("column")])
    side = best.select("dataset", "term", F.col("column").alias("__c"), F.col("confidence").alias("__s"), F.col("completeness").alias("__f"))
    joined = _with_every_term(decisions, side)
    take = F.col("__c").isNotNull() & ~(F.col("applied") & much_fuller(F.col("completeness"), F.col("__f")))
    return _overridden(joined, F.coalesce(take, F.lit(False)), "ALIAS", "known_synonym").drop("__c", "__s", "__f")


def override_with_template(decisions: DataFrame, profile: DataFrame, template: DataFrame) -> DataFrame:
    """Template items (term, columns, priority) take the first of their columns the dataset has."""
    items = template.select("term", "priority", F.posexplode("columns").alias("at", "column"))
    hits = profile.select("dataset", "column").join(items, "column")
    best = first_per_key(hits, ["dataset", "term"], [F.col("priority"), F.col("at"), F.col("column")])
    side = best.select("dataset", "term", F.col("column").alias("__c"), F.lit(1.0).alias("__s"))
    joined = _with_every_term(decisions, side)
    return _overridden(joined, F.col("__c").isNotNull(), "TEMPLATE", "template").drop("__c", "__s")


def _with_every_term(decisions: DataFrame, side: DataFrame) -> DataFrame:
    """Decisions and what overrides them; a term no header was a candidate for starts as not applied."""
    return decisions.join(side, ["dataset", "term"], "full_outer").withColumn("applied", F.coalesce("applied", F.lit(False)))


def _overridden(joined: DataFrame, take: Column, status: str, reason: str) -> DataFrame:
    return joined.withColumns({
        "column": F.when(take, F.col("__c")).otherwise(F.col("column")), "final_score": F.when(take, F.col("__s")).otherwise(F.col("final_score")),
        "status": F.when(take, status).otherwise(F.col("status")), "reason": F.when(take, reason).otherwise(F.col("reason")),
        "applied": take | F.col("applied"),
    })


def usable_templates(catalogue: DataFrame, version: str, institution: str, use_case: str) -> DataFrame:
    """Templates whose version window and owner fit."""
    window = (F.coalesce("valid_from", F.lit("")) <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") >= version))
    return catalogue.filter(window & (is_blank("institution") | (F.col("institution") == institution)) & (is_blank("use_case") | (F.col("use_case") == use_case)))


def verbatim_fallback(decisions: DataFrame, options: Options = Options()) -> DataFrame:
    """(dataset, term, column, final_score): verbatim terms that take the column of their primary term."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in VERBATIM_OF.items() for x in kv]), F.col("term"))
    primary = decisions.filter(F.col("applied") & (F.col("final_score") >= options.suggest)).withColumn("target", target).filter(F.col("target").isNotNull())
    taken = decisions.filter("applied").select("dataset", F.col("term").alias("target"))
    free = primary.join(taken, ["dataset", "target"], "left_anti")
    score = F.least(F.lit(1.0), F.greatest(F.lit(options.suggest), F.col("final_score") * 0.90))
    return free.select("dataset", F.col("target").alias("term"), "column", score.alias("final_score"))


def loser_fallback(decisions: DataFrame, options: Options = Options()) -> DataFrame:
    """(dataset, term, column, final_score): free verbatim terms that take a column a primary term lost to another.

    Of several losers for one verbatim term the best scored wins, then the first by term and column."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in VERBATIM_OF.items() for x in kv]), F.col("term"))
    lost = decisions.filter((F.col("reason") == "conflict_lost") & (F.col("final_score") >= options.suggest))
    lost = lost.select("dataset", target.alias("target"), "term", F.col("candidate").alias("column"), "final_score").filter("target IS NOT NULL")
    taken = decisions.filter("applied").select("dataset", F.col("term").alias("target"))
    free = lost.join(taken, ["dataset", "target"], "left_anti")
    best = first_per_key(free, ["dataset", "target"], [-F.col("final_score"), F.col("term"), F.col("column")])
    return best.select("dataset", F.col("target").alias("term"), "column", F.least(F.lit(1.0), "final_score").alias("final_score"))


def one_term_per_column(decisions: DataFrame) -> DataFrame:
    """Overrides may give one column to several terms: template before alias before score, then the term name, keeps it."""
    rank = F.when(F.col("status") == "TEMPLATE", 0).when(F.col("status") == "ALIAS", 1).otherwise(2)
    order = Window.partitionBy("dataset", "column").orderBy(rank, F.desc("final_score"), "term")
    claimed = decisions.filter("applied").withColumn("claim", F.row_number().over(order))
    lost = F.coalesce(F.col("claim") > 1, F.lit(False))
    side = claimed.select("dataset", "term", "claim")
    joined = decisions.join(side, ["dataset", "term"], "left")
    return joined.withColumns({
        "candidate": F.when(lost, F.col("column")).otherwise(F.col("candidate")), "applied": F.col("applied") & ~lost,
        "column": F.when(~lost, F.col("column")), "status": F.when(lost, "MANUAL").otherwise(F.col("status")),
        "reason": F.when(lost, "conflict_lost").otherwise(F.col("reason")),
    }).drop("claim")


def map_catalogue(
    profile: DataFrame, synonyms: DataFrame | None = None, aliases: DataFrame | None = None, template: DataFrame | None = None,
    options: Options = Options(),
) -> DataFrame:
    """(dataset, term, column, final_score, status, reason): the mapping of every dataset of a catalogue.

    Scored and decided, then learned aliases, then the template, one term per column again, then verbatim terms from
    losers and from primary terms. A decision that breaks the contract is an error. Header rows are written twice on
    the way, so that no branch scores them again."""
    ensure_checkpoint_dir(profile.sparkSession)
    decisions = decide(candidates(profile, synonyms, options=options), options).checkpoint()
    if aliases is not None:
        decisions = override_with_aliases(decisions, profile, aliases, options)
    if template is not None:
        decisions = override_with_template(decisions, profile, template)
    decisions = one_term_per_column(decisions).checkpoint()
    bad = check_decisions(decisions).agg(F.count("*").alias("n")).scalar()
    columns = ["dataset", "term", "column", "final_score", "status", "reason"]
    kept = decisions.filter("applied").select(*columns)
    losers = loser_fallback(decisions, options).select(
        "dataset", "term", "column", "final_score", F.lit("SUGGESTED").alias("status"), F.lit("fallback_verbatim_from_loser").alias("reason"))
    primary = verbatim_fallback(decisions, options).join(losers.select("dataset", "term"), ["dataset", "term"], "left_anti").select(
        "dataset", "term", "column", "final_score", F.lit("SUGGESTED").alias("status"), F.lit("fallback_verbatim_from_primary").alias("reason"))
    whole = kept.unionByName(losers).unionByName(primary)
    broken = F.raise_error(F.lit("decisions break the contract"))
    return whole.withColumn("status", F.when(bad > 0, broken).otherwise(F.col("status")))


def check_decisions(decisions: DataFrame) -> DataFrame:
    """Rows that break the contract: unknown status, score out of range, applied without a column."""
    known = F.col("status").isin("AUTO", "SUGGESTED", "AMBIGUOUS", "MANUAL", "ALIAS", "TEMPLATE", "EDITED")
    bad = (
        F.when(~known, "status").when(~F.col("final_score").between(0, 1), "score").when(F.col("applied") & F.col("column").isNull(), "column")
    )
    return decisions.withColumn("violation", bad).filter(F.col("violation").isNotNull()).select("dataset", "term", "violation")


def learn_aliases(aliases: DataFrame, accepted: DataFrame, run_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(aliases, events) after a run: accepted pairs (scope, owner, column, term) are confirmed or added,
    other terms of the same header are superseded."""
    key = ["scope", "owner", "column", "term"]
    fresh = accepted.select(*key).distinct().withColumn("__new", F.lit(True))
    heads = fresh.select("scope", "owner", "column").distinct().withColumn("__touched", F.lit(True))
    joined = aliases.join(fresh, key, "full_outer").join(heads, ["scope", "owner", "column"], "left")
    was, now_seen = F.col("alias_id").isNotNull(), F.coalesce("__new", F.lit(False))
    event = (
        F.when(now_seen & was, "confirmed").when(now_seen, "created")
        .when(F.coalesce("__touched", F.lit(False)) & F.coalesce("active", F.lit(False)), "superseded")
    )
    merged = joined.withColumn("event", event)
    learned = F.least(F.lit(1.0), F.coalesce(F.col("confidence") + 0.05, F.lit(0.80)))
    out = merged.select(
        F.coalesce("alias_id", F.xxhash64(*key)).alias("alias_id"), *key,
        F.when(now_seen, learned).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"),
        F.when(F.col("event").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(now_seen, True).when(F.col("event") == "superseded", False).otherwise(F.col("active")).alias("active"),
    )
    events = merged.filter(F.col("event").isNotNull()).select(*key, "event", F.lit(run_id).alias("run_id"), F.coalesce("active", F.lit(False)).alias("was_active"))
    return out, events


def undo_run(aliases: DataFrame, events: DataFrame, run_id: str) -> DataFrame:
    """Aliases as they were before a run: its own entries go, superseded ones come back."""
    key = ["scope", "owner", "column", "term"]
    mine = events.filter(F.col("run_id") == run_id).select(*key, "event", "was_active")
    joined = aliases.join(mine, key, "left").filter(F.coalesce(F.col("event") != "created", F.lit(True)))
    return joined.withColumn("active", F.when(F.col("event").isNotNull(), F.col("was_active")).otherwise(F.col("active"))).drop("event", "was_active")


def alias_intervals(log: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """(scope, owner, column, term, confidence, from_run, to_run): when each learned alias held.

    log: run, scope, owner, column, term - what users accepted, run by run. A header has one term at a time: another
    one supersedes it from that run on, a repeat confirms it. Runs listed in `undone` (run) count as never made, so what they
    superseded holds on. `to_run` is null for what holds still; the state at a run is a filter on the two."""
    made = log if undone is None else log.join(undone.select("run").distinct(), "run", "left_anti")
    head = ["scope", "owner", "column"]
    steps = made.groupBy(*head, "run").agg(F.max("term").alias("term"))
    order = Window.partitionBy(*head).orderBy("run")
    times = F.row_number().over(Window.partitionBy(*head, "term").orderBy("run"))
    steps = steps.withColumns({"to_run": F.lead("run").over(order), "k": times})
    learned = F.least(F.lit(1.0), 0.80 + 0.05 * (F.col("k") - 1))
    return steps.select(*head, "term", F.round(learned, 2).alias("confidence"), F.col("run").alias("from_run"), "to_run")


def aliases_at(intervals: DataFrame, run: int) -> DataFrame:
    """The aliases that hold after a run."""
    return intervals.filter((F.col("from_run") <= run) & (F.col("to_run").isNull() | (F.col("to_run") > run)))


def compose_ratio(df: DataFrame, composed: Column, any_input: Column) -> DataFrame:
    """One row: share of rows with input whose composition is valid."""
    return df.agg(F.count_if(any_input).alias("input_n"), F.count_if(any_input & composed.isNotNull()).alias("valid_n")).withColumn(
        "ratio", F.col("valid_n") / F.nullif("input_n", F.lit(0)))


def compose_missing(decisions: DataFrame, df: DataFrame, dataset: str, options: Options = Options()) -> DataFrame:
    """Compose scientificName (genus, epithet) and eventDate (year, month, day) where the term has no column
    but its parts do. Adds `composed_from` (parts as a list); scores by the share of valid rows."""
    from quadrat.functions.dates import compose_date
    from quadrat.functions.names import compose_name

    picked = {r["term"]: r["column"] for r in decisions.filter((F.col("dataset") == dataset) & F.col("applied")).select("term", "column").collect()}
    out = decisions.withColumn("composed_from", F.lit(None).cast("array<string>"))
    plans = {"scientificName": ["genus", "specificEpithet"], "eventDate": [t for t in ("year", "month", "day") if t in picked]}
    for term, parts in plans.items():
        if term in picked or not parts or not all(p in picked for p in parts) or (term == "eventDate" and "year" not in parts):
            continue
        columns = [F.col(f"`{picked[p]}`") for p in parts]
        if term == "scientificName":
            value = compose_name(*columns)
        else:
            value = compose_date(*(columns + [None] * (3 - len(columns))))["value"]
        row = compose_ratio(df, value, any_of([~is_blank(c) for c in columns])).first()
        if not row["input_n"] or row["ratio"] < options.veto:
            continue
        hit = (F.col("dataset") == dataset) & (F.col("term") == term)
        score = min(1.0, max(options.suggest, row["ratio"]))
        out = out.withColumns({
            "final_score": F.when(hit, score).otherwise(F.col("final_score")), "status": F.when(hit, "SUGGESTED").otherwise(F.col("status")),
            "reason": F.when(hit, f"composed_{term}").otherwise(F.col("reason")),
            "composed_from": F.when(hit, F.array(*[F.lit(picked[p]) for p in parts])).otherwise(F.col("composed_from")),
        })
    return out


def auto_map(df: DataFrame, dataset: str = "data", synonyms: DataFrame | None = None, row_id: str = "row_id", options: Options = Options()) -> DataFrame:
    """Profile a table and decide its mapping in one go. The profile, a row per header, is written once for all who read it."""
    from quadrat.operators.stats import column_profile

    ensure_checkpoint_dir(df.sparkSession)
    profile = column_profile(df, [c for c in df.columns if c != row_id]).withColumn("dataset", F.lit(dataset)).checkpoint()
    return compose_missing(decide(candidates(profile, synonyms, options=options), options), df, dataset, options)
