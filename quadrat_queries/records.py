"""Record-level operators: identifiers, duplicates, vocabularies, countries, names, problems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.functions.identifiers import content_text, persistent_id
from quadrat.lookups import local_table, term_catalogue, vocabulary
from quadrat.operators import ids as I
from quadrat.operators import numbering as W
from quadrat.operators import quality as P
from quadrat.operators import taxa as T
from quadrat.operators import vocabularies as V
from quadrat.operators import countries as K
from quadrat.session import ensure_checkpoint_dir
from quadrat_queries.fixtures import (
    COUNTRY_SQL, LAT_SQL, LON_SQL, NAMES_CTE, THREATENED_CTE, invasive, mapped, reviews, threatened, with_mapped,
)
from quadrat_queries.occ import AS_OF_YEAR, occ, table, with_occ
from quadrat_queries.registry import query

UUID_SQL = (
    "concat('urn:uuid:', substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', "
    "translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3), '-', substr(h, 21, 12))"
)
HASH_SQL = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(content || chr(30) || number))"

#: Lines in one slice of a hot group: fewer than any of the three groups has on the given tables.
SLICE_ROWS = 1_000


@query(
    "id_content_uuid",
    with_occ(
        ", c AS (SELECT row_id, concat_ws(chr(31), CASE WHEN especie = 'NA' THEN chr(28) || 'NA' ELSE especie END, pais, sexo) AS content FROM occ), "
        "n AS (SELECT row_id, content, row_number() OVER (PARTITION BY content ORDER BY row_id) AS number FROM c), "
        f"h AS (SELECT row_id, {HASH_SQL} AS h FROM n) SELECT row_id, {UUID_SQL} AS occurrenceID FROM h"
    ),
)
def id_content_uuid(spark, sf):
    return I.generate_ids(occ(spark, sf).select("row_id", "especie", "pais", "sexo"), ["especie", "pais", "sexo"], hot_rows=50)


_TAKEN = "n IN (2, 3, 5, 6, 7)"


@query(
    "id_taken_numbers_passed",
    with_occ(
        ", c AS (SELECT row_id, concat_ws(chr(31), CASE WHEN especie = 'NA' THEN chr(28) || 'NA' ELSE especie END, pais, sexo) AS content FROM occ), "
        "r AS (SELECT row_id, content, row_number() OVER (PARTITION BY content ORDER BY row_id) AS r, count(*) OVER (PARTITION BY content) AS m FROM c), "
        "s AS (SELECT content, m, unnest(range(1, m + 6)) AS n FROM (SELECT DISTINCT content, m FROM r)), "
        f"f AS (SELECT content, n AS number, row_number() OVER (PARTITION BY content ORDER BY n) AS r FROM s WHERE NOT ({_TAKEN} AND n <= m)), "
        "n AS (SELECT row_id, content, number FROM r JOIN f USING (content, r)), "
        f"h AS (SELECT row_id, {HASH_SQL} AS h FROM n) SELECT row_id, {UUID_SQL} AS occurrenceID FROM h"
    ),
)
def id_taken_numbers_passed(spark, sf):
    """New identifiers for all rows while some numbers of each content are taken."""
    columns = ["especie", "pais", "sexo"]
    base = occ(spark, sf).select("row_id", *columns)
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy("row_id"))
    first = base.withColumn("n", rank).filter("n <= 7").filter(_TAKEN).select("row_id")
    taken = I.generate_ids(base, columns).join(first, "row_id", "left_semi").select(F.col("occurrenceID").alias("id"))
    return I.generate_ids(base, columns, taken, hot_rows=50)


@query(
    "id_resolved",
    with_occ(
        ", c AS (SELECT row_id, trim(tombo) AS given, concat_ws(chr(31), CASE WHEN especie = 'NA' THEN chr(28) || 'NA' ELSE especie END, pais, sexo) AS content FROM occ), "
        "n AS (SELECT row_id, given, content, row_number() OVER (PARTITION BY given = '', content ORDER BY row_id) AS number FROM c), "
        f"h AS (SELECT row_id, given, {HASH_SQL} AS h FROM n) "
        f"SELECT row_id, CASE WHEN given <> '' THEN given ELSE {UUID_SQL} END AS occurrenceID, "
        "CASE WHEN given <> '' THEN 'supplied' ELSE 'generated' END AS id_origin FROM h"
    ),
)
def id_resolved(spark, sf):
    base = occ(spark, sf).select("row_id", "tombo", "especie", "pais", "sexo")
    return I.resolve_ids(base, "tombo").select("row_id", "occurrenceID", "id_origin")


@query(
    "id_counts",
    with_occ(
        "SELECT count(*) AS total, count(*) FILTER (trim(tombo) <> '') AS preserved, count(*) FILTER (trim(tombo) = '') AS generated, "
        "'user_supplied_with_generated' AS strategy FROM occ"
    ),
)
def id_counts(spark, sf):
    return I.id_counts(id_resolved(spark, sf))


@query(
    "id_uniqueness",
    with_occ(
        "SELECT count(*) AS total, count(*) FILTER (tombo <> '') AS filled, count(*) FILTER (tombo = '') AS blank, "
        "count(*) FILTER (tombo <> '') - count(DISTINCT nullif(tombo, '')) AS duplicates, "
        "count(*) FILTER (tombo <> '') = count(DISTINCT nullif(tombo, '')) AS ok FROM occ"
    ),
)
def id_uniqueness(spark, sf):
    return I.id_uniqueness(occ(spark, sf), "tombo")


@query(
    "id_repeats_replaced",
    with_occ(
        ", r AS (SELECT *, count(*) OVER (PARTITION BY tombo) > 1 AND tombo <> '' AS repeated FROM occ), "
        "c AS (SELECT row_id, tombo, repeated, concat_ws(chr(31), CASE WHEN especie = 'NA' THEN chr(28) || 'NA' ELSE especie END, data_registro) AS content FROM r), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY repeated, content ORDER BY row_id) AS number FROM c), "
        f"h AS (SELECT *, {HASH_SQL} AS h FROM n) "
        f"SELECT row_id, CASE WHEN repeated THEN {UUID_SQL} ELSE tombo END AS occurrenceID, repeated AS id_replaced FROM h"
    ),
)
def id_repeats_replaced(spark, sf):
    base = occ(spark, sf).select("row_id", F.col("tombo").alias("occurrenceID"), "especie", "data_registro")
    return I.replace_repeated_ids(base, ["especie", "data_registro"]).select("row_id", "occurrenceID", "id_replaced")


@query(
    "rows_numbered_within_group",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY "
    "l_orderkey * 100000000000 + l_partkey * 10000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT)) AS number FROM lineitem "
    "QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber, l_quantity) = 1",
)
def rows_numbered_within_group(spark, sf):
    """The lines whose key is unique, with their numbers among all lines."""
    numbered = rows_numbered_whole_table(spark, sf)
    key = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    once = numbered.groupBy(*key).agg(F.count("*").alias("n")).filter("n = 1").select(*key)
    return numbered.join(once, key, "left_semi").select(*key, "number")


@query(
    "rows_numbered_whole_table",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY "
    "l_orderkey, l_partkey, l_linenumber, l_quantity) AS number FROM lineitem",
)
def rows_numbered_whole_table(spark, sf):
    """Three groups share all lines, so the slices of hot groups are exercised. Lines of one key differ in nothing shown.

    The order column is unique and dense in each sorted range of lines; it is written once, so that all uses agree."""
    key = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    ranged = table(spark, sf, "lineitem").select(*key, "l_returnflag").repartitionByRange(*key).sortWithinPartitions(*key)
    ensure_checkpoint_dir(spark)
    lines = ranged.withColumn("row_id", F.monotonically_increasing_id()).checkpoint()
    return W.number_within(lines, ["l_returnflag"], "number", hot_rows=SLICE_ROWS).select(*key, "number")


@query(
    "rows_exact_copies",
    "SELECT row_id, first_id AS \"of\" FROM (SELECT o_orderkey AS row_id, min(o_orderkey) OVER "
    "(PARTITION BY o_orderstatus, o_orderpriority, o_orderdate) AS first_id FROM orders) WHERE row_id > first_id",
)
def rows_exact_copies(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id")
    return W.exact_copies(orders, ["o_orderstatus", "o_orderpriority", "o_orderdate"])


@query(
    "rows_repeated_id_flag",
    with_occ("SELECT row_id, tombo <> '' AND count(*) OVER (PARTITION BY tombo) > 1 AS repeated FROM occ"),
)
def rows_repeated_id_flag(spark, sf):
    return W.repeated_flag(occ(spark, sf), "tombo").select("row_id", "repeated")


@query(
    "rows_event_counter",
    "SELECT event_id, concat(CAST(user_id AS VARCHAR), '-obs-', CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR)) "
    "AS observationID FROM events",
)
def rows_event_counter(spark, sf):
    from quadrat.sources.camtrap import observation_ids

    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("eventID"))
    return observation_ids(events, "event_id").select("event_id", "observationID")


# ---- vocabularies ------------------------------------------------------------------------------


@query(
    "vocabulary_mapped",
    with_occ(
        "SELECT row_id, CASE lower(trim(sexo)) WHEN 'm' THEN 'male' WHEN 'f' THEN 'female' WHEN '' THEN NULL ELSE sexo END AS sex, "
        "CASE status WHEN 'visto' THEN 'present' WHEN '1' THEN 'present' WHEN '' THEN NULL ELSE status END AS occurrenceStatus FROM occ"
    ),
)
def vocabulary_mapped(spark, sf):
    return occ(spark, sf).select(
        "row_id", V.map_vocabulary("sex", "sexo").alias("sex"),
        V.map_vocabulary("occurrenceStatus", V.occurrence_status("status")).alias("occurrenceStatus"),
    )


@query(
    "vocabulary_suggested",
    with_occ(
        "SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'juvenile|nestling' WHEN 1 THEN 'juvenile|neonate' END AS targets FROM occ"
    ),
)
def vocabulary_suggested(spark, sf):
    word = F.when(F.col("row_id") % 3 == 0, "Filhote").when(F.col("row_id") % 3 == 1, "cria").otherwise("dragon")
    return occ(spark, sf).select("row_id", V.vocabulary_suggestions("lifeStage", word).alias("targets"))


@query(
    "vocabulary_words_used",
    with_mapped(
        "SELECT 'sex' AS term, CASE lower(sex) WHEN 'm' THEN 'male' WHEN 'f' THEN 'female' ELSE sex END AS target, true AS auto, count(*) AS n "
        "FROM mapped WHERE sex IN ('M', 'F', 'male') GROUP BY 2"
    ),
)
def vocabulary_words_used(spark, sf):
    """How often the words of the vocabulary table occur, by controlled term."""
    used = mapped(spark, sf).groupBy(V.vocabulary_key("sex").alias("key")).agg(F.count("*").alias("n"))
    words = vocabulary(spark).filter("term = 'sex'")
    return used.join(F.broadcast(words), "key").groupBy("term", "target", "auto").agg(F.sum("n").alias("n"))


@query(
    "term_catalogue_coverage",
    with_mapped(
        "SELECT 'scientificName' AS term, true AS required, count(*) FILTER (scientificName <> '') AS filled FROM mapped "
        "UNION ALL SELECT 'eventDate', true, count(*) FILTER (eventDate <> '') FROM mapped "
        "UNION ALL SELECT 'sex', false, count(*) FILTER (sex <> '') FROM mapped"
    ),
)
def term_catalogue_coverage(spark, sf):
    names = ["scientificName", "eventDate", "sex"]
    counts = mapped(spark, sf).agg(*[F.count_if(F.col(c) != "").alias(c) for c in names]).unpivot([], names, "term", "filled")
    return counts.join(term_catalogue(spark).select("term", "required"), "term").select("term", "required", "filled")


BASIS_CASE = (
    "CASE row_id % 5 WHEN 0 THEN 'HumanObservation' WHEN 1 THEN 'PreservedSpecimen' WHEN 2 THEN 'MachineObservation' "
    "WHEN 3 THEN 'LivingSpecimen' ELSE 'Occurrence' END"
)


@query("basis_of_record_mapped", with_occ(f"SELECT row_id, {BASIS_CASE} AS basisOfRecord FROM occ"))
def basis_of_record_mapped(spark, sf):
    raw = (
        F.when(F.col("row_id") % 5 == 0, "Observação de campo").when(F.col("row_id") % 5 == 1, "Preserved specimen")
        .when(F.col("row_id") % 5 == 2, "armadilha-fotográfica").when(F.col("row_id") % 5 == 3, "zoo").otherwise("")
    )
    decisions = local_table(spark, {"key": ["zoo", "∅"], "term": ["LivingSpecimen", "Occurrence"]})
    return V.map_basis_of_record(occ(spark, sf).withColumn("raw", raw), "raw", decisions).select("row_id", "basisOfRecord")


@query(
    "vocabulary_distinct_values",
    with_occ(
        "SELECT CASE WHEN lower(sexo) = '' THEN '∅' ELSE lower(sexo) END AS key, arg_min(sexo, row_id) AS raw, count(*) AS n FROM occ GROUP BY 1"
    ),
)
def vocabulary_distinct_values(spark, sf):
    return V.distinct_values(occ(spark, sf), "sexo")


@query(
    "species_entries",
    with_occ(
        "SELECT lower(trim(especie)) AS key, arg_min(especie, row_id) AS raw, count(*) AS n_records FROM occ WHERE trim(especie) <> '' GROUP BY 1"
    ),
)
def species_entries(spark, sf):
    return V.species_entries(occ(spark, sf), "especie")


ANSWERS = {
    "key": ["panthera onca", "Felidae", "euterpe edulis mart."], "means": ["native", "introduced", "native"],
    "degree": ["", "established", "cultivated"], "island_means": ["", "", "introduced"], "island_degree": ["", "", ""],
}


@query(
    "establishment_answers",
    with_occ(
        "SELECT row_id, CASE WHEN row_id % 7 = 0 THEN 'nativeEndemic' WHEN lower(trim(especie)) = 'panthera onca' THEN 'native' "
        "WHEN especie = 'Felidae' THEN 'introduced' WHEN especie = 'Euterpe edulis Mart.' THEN 'native' ELSE '' END AS establishmentMeans FROM occ"
    ),
)
def establishment_answers(spark, sf):
    own = occ(spark, sf).withColumn("own", F.when(F.col("row_id") % 7 == 0, "Native Endemic").otherwise("?"))
    return V.with_establishment(own, local_table(spark, ANSWERS), "especie", "means", "own").select("row_id", "establishmentMeans")


@query(
    "establishment_lost_values",
    with_occ("SELECT coletor AS raw, count(*) AS n_records FROM occ GROUP BY coletor"),
)
def establishment_lost_values(spark, sf):
    published = occ(spark, sf).withColumn("published", V.canonical_establishment("coletor"))
    return V.dropped_establishment(published, "coletor", "published")


@query("establishment_answer_coverage", "SELECT 3 AS answered_means, 2 AS answered_degree, 2 AS missing_degree FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def establishment_answer_coverage(spark, sf):
    answers = local_table(spark, ANSWERS)
    used = occ(spark, sf).select(F.lower(F.trim("especie")).alias("k")).distinct()
    kept = answers.join(used, F.lower("key") == F.col("k"), "left_semi")
    return V.answer_coverage(kept)


ISLAND_SQL = (
    f"CASE WHEN {LAT_SQL} BETWEEN 0.85 AND 0.96 AND {LON_SQL} BETWEEN -29.40 AND -29.30 THEN 'São Pedro e São Paulo' "
    f"WHEN {LAT_SQL} BETWEEN -20.60 AND -20.40 AND {LON_SQL} BETWEEN -29.40 AND -28.80 THEN 'Trindade e Martim Vaz' "
    f"WHEN {LAT_SQL} BETWEEN -3.92 AND -3.82 AND {LON_SQL} BETWEEN -33.86 AND -33.76 THEN 'Atol das Rocas' "
    f"WHEN {LAT_SQL} BETWEEN -3.98 AND -3.78 AND {LON_SQL} BETWEEN -32.55 AND -32.33 THEN 'Fernando de Noronha' END"
)


@query(
    "island_of_point",
    with_mapped(
        ", moved AS (SELECT row_id, scientificName, CASE WHEN row_id % 4 = 0 THEN '-3,85' ELSE decimalLatitude END AS decimalLatitude, "
        "CASE WHEN row_id % 4 = 0 THEN '-32.40' ELSE decimalLongitude END AS decimalLongitude FROM mapped) "
        f"SELECT row_id, {ISLAND_SQL} AS island, CASE WHEN scientificName = 'Euterpe edulis Mart.' THEN {ISLAND_SQL} END AS species_island FROM moved"
    ),
)
def island_of_point(spark, sf):
    moved = mapped(spark, sf).select(
        "row_id", "scientificName",
        F.when(F.col("row_id") % 4 == 0, "-3,85").otherwise(F.col("decimalLatitude")).alias("la"),
        F.when(F.col("row_id") % 4 == 0, "-32.40").otherwise(F.col("decimalLongitude")).alias("lo"),
    )
    marked = V.with_establishment_island(moved, invasive(spark), "scientificName", "la", "lo", "species_island")
    return marked.select("row_id", V.oceanic_island("la", "lo").alias("island"), "species_island")


# ---- countries ---------------------------------------------------------------------------------


@query("country_iso3", with_occ(f"SELECT row_id, {COUNTRY_SQL.format('pais')} AS iso3 FROM occ"))
def country_iso3(spark, sf):
    return K.with_country_codes(occ(spark, sf), {"pais": "iso3"}).select("row_id", "iso3")


@query(
    "country_names_of_nations",
    "SELECT n_nationkey, n_name, CASE n_name WHEN 'BRAZIL' THEN 'BRA' WHEN 'ARGENTINA' THEN 'ARG' WHEN 'CANADA' THEN 'CAN' "
    "WHEN 'EGYPT' THEN 'EGY' WHEN 'ETHIOPIA' THEN 'ETH' WHEN 'FRANCE' THEN 'FRA' WHEN 'GERMANY' THEN 'DEU' WHEN 'INDIA' THEN 'IND' "
    "WHEN 'INDONESIA' THEN 'IDN' WHEN 'IRAN' THEN 'IRN' WHEN 'IRAQ' THEN 'IRQ' WHEN 'JAPAN' THEN 'JPN' WHEN 'JORDAN' THEN 'JOR' "
    "WHEN 'KENYA' THEN 'KEN' WHEN 'MOROCCO' THEN 'MAR' WHEN 'MOZAMBIQUE' THEN 'MOZ' WHEN 'PERU' THEN 'PER' WHEN 'CHINA' THEN 'CHN' "
    "WHEN 'ROMANIA' THEN 'ROU' WHEN 'SAUDI ARABIA' THEN 'SAU' WHEN 'VIETNAM' THEN 'VNM' WHEN 'RUSSIA' THEN 'RUS' "
    "WHEN 'UNITED KINGDOM' THEN 'GBR' WHEN 'UNITED STATES' THEN 'USA' WHEN 'ALGERIA' THEN 'DZA' END AS iso3 FROM nation",
)
def country_names_of_nations(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return K.with_country_codes(nations, {"n_name": "iso3"}, fuzzy=False).select("n_nationkey", "n_name", "iso3")


@query(
    "country_fuzzy_tokens",
    with_occ("SELECT DISTINCT 'brazl' AS token, 'BRA' AS iso3 FROM occ WHERE pais = 'Brazl'"),
)
def country_fuzzy_tokens(spark, sf):
    from quadrat.functions.text import country_token
    from quadrat.lookups import country_reference

    reference = country_reference(spark)
    tokens = occ(spark, sf).select(country_token("pais").alias("token")).distinct().join(reference, "token", "left_anti")
    return K.fuzzy_countries(tokens.filter("token <> ''"), reference)


@query(
    "country_code_filled",
    with_mapped(
        f"SELECT row_id, CASE countryCode WHEN 'BRA' THEN 'BR' WHEN 'ESP' THEN 'ES' WHEN '' THEN CASE {COUNTRY_SQL.format('country')} "
        "WHEN 'BRA' THEN 'BR' WHEN 'ARG' THEN 'AR' WHEN 'ESP' THEN 'ES' WHEN 'VUT' THEN 'VU' END ELSE countryCode END AS countryCode FROM mapped"
    ),
)
def country_code_filled(spark, sf):
    base = mapped(spark, sf).select("row_id", "country", "countryCode")
    return K.with_alpha2(K.derive_country_code(base)).select("row_id", "countryCode")


@query(
    "country_is_brazilian",
    with_mapped(
        "SELECT row_id, coalesce(CASE countryCode WHEN 'BRA' THEN 'BRA' WHEN 'br' THEN 'BRA' WHEN 'AR' THEN 'ARG' WHEN 'ESP' THEN 'ESP' END, "
        f"{COUNTRY_SQL.format('country')}, '') = 'BRA' AS is_brazilian FROM mapped"
    ),
)
def country_is_brazilian(spark, sf):
    return K.with_is_brazilian(mapped(spark, sf)).select("row_id", "is_brazilian")


# ---- names -------------------------------------------------------------------------------------


@query(
    "name_parsed",
    with_mapped(
        NAMES_CTE + " SELECT m.row_id, n.taxon_key, n.canonical, n.taxon_rank, n.author, n.qualifier FROM mapped m "
        "LEFT JOIN names n ON m.scientificName = n.name"
    ),
)
def name_parsed(spark, sf):
    parsed = T.with_name_parts(mapped(spark, sf).select("row_id", "scientificName"))
    p = F.col("parts")
    return parsed.select(
        "row_id", T.taxon_key(p).alias("taxon_key"), p["canonicalName"].alias("canonical"), p["taxonRank"].alias("taxon_rank"),
        p["scientificNameAuthorship"].alias("author"), p["identificationQualifier"].alias("qualifier"),
    )


@query(
    "name_threatened_lookup",
    with_mapped(
        NAMES_CTE + THREATENED_CTE + " SELECT m.row_id, t.category, t.source FROM mapped m LEFT JOIN names n ON m.scientificName = n.name "
        "LEFT JOIN threatened t ON n.taxon_key = t.match_key"
    ),
)
def name_threatened_lookup(spark, sf):
    return T.threatened_category(mapped(spark, sf), threatened(spark)).select("row_id", "category", "source")


@query(
    "name_invasive_lookup",
    with_mapped(
        NAMES_CTE + " SELECT m.row_id, coalesce(n.taxon_key IN ('puma concolor', 'euterpe edulis', 'panthera onca'), false) AS invasive, "
        "CASE n.taxon_key WHEN 'puma concolor' THEN 'alien' WHEN 'euterpe edulis' THEN 'translocated_native' "
        "WHEN 'panthera onca' THEN 'translocated_native' END AS origin_class, "
        "CASE WHEN n.taxon_key = 'puma concolor' THEN 'introduced' ELSE '' END AS suggested_means "
        "FROM mapped m LEFT JOIN names n ON m.scientificName = n.name"
    ),
)
def name_invasive_lookup(spark, sf):
    listed = T.invasive_info(mapped(spark, sf).select("row_id", "scientificName"), invasive(spark))
    both = T.suggest_establishment_means(
        listed.withColumnRenamed("origin_class", "o").drop("introduction_reason", "native_range"), invasive(spark))
    return both.select("row_id", "invasive", F.col("o").alias("origin_class"), "suggested_means")


@query(
    "name_sensitivity_decided",
    with_mapped(
        NAMES_CTE + THREATENED_CTE + " SELECT m.row_id, CASE WHEN n.taxon_key = 'puma concolor' THEN false WHEN n.taxon_key = 'felidae' THEN true "
        "ELSE t.category IS NOT NULL END AS sensitive, CASE WHEN n.taxon_key = 'felidae' THEN 'NT' ELSE t.category END AS category "
        "FROM mapped m LEFT JOIN names n ON m.scientificName = n.name LEFT JOIN threatened t ON n.taxon_key = t.match_key"
    ),
)
def name_sensitivity_decided(spark, sf):
    return T.resolve_sensitivity(mapped(spark, sf), threatened(spark), _decisions(spark)).select("row_id", "sensitive", "category")


def _decisions(spark):
    return local_table(
        spark, {"scientificName": ["Puma concolor", "Felidae", "Euterpe edulis"], "sensitive": ["no", "TRUE", "yes"],
                "category": [None, "NT", None]},
    )


@query(
    "name_decisions_rekeyed",
    "SELECT * FROM (VALUES ('Puma concolor', false, NULL), ('Felidae', true, 'NT'), ('Euterpe edulis', true, NULL), "
    "('Euterpe precatoria Mart.', true, NULL)) t(\"scientificName\", sensitive, category) WHERE (SELECT count(*) FROM orders) > 0",
)
def name_decisions_rekeyed(spark, sf):
    return T.rekey_decisions(_decisions(spark), reviews(spark, sf))


@query(
    "name_reviews_applied",
    with_mapped(
        NAMES_CTE + " SELECT m.row_id, CASE WHEN n.taxon_key = 'euterpe edulis' THEN 'Euterpe precatoria' ELSE m.scientificName END AS scientificName, "
        "CASE WHEN n.taxon_key = 'euterpe edulis' THEN 'Mart.' END AS scientificNameAuthorship FROM mapped m LEFT JOIN names n ON m.scientificName = n.name"
    ),
)
def name_reviews_applied(spark, sf):
    done = T.apply_name_reviews(mapped(spark, sf).select("row_id", "scientificName"), reviews(spark, sf))
    return done.select("row_id", "scientificName", "scientificNameAuthorship")


@query(
    "name_ranks_applied",
    with_mapped(
        "SELECT row_id, CASE WHEN scientificName = 'Felidae' THEN 'family' ELSE 'genus' END AS taxonRank, "
        "CASE WHEN scientificName = 'Felidae' THEN '' ELSE scientificName END AS genus FROM mapped"
    ),
)
def name_ranks_applied(spark, sf):
    report = local_table(
        spark, {"query_name": ["Felidae", "Panthera onca"], "taxonRank": ["FAMILY", "species"], "validation_status": ["accepted", "accepted"]}
    )
    base = mapped(spark, sf).select("row_id", "scientificName", F.lit("genus").alias("taxonRank"), F.col("scientificName").alias("genus"))
    return T.apply_name_ranks(base, T.name_ranks(report)).select("row_id", "taxonRank", "genus")


@query(
    "name_synonym_decisions",
    with_mapped(
        "SELECT DISTINCT scientificName, true AS sensitive, 'VU' AS category FROM mapped WHERE scientificName = 'Felidae'"
    ),
)
def name_synonym_decisions(spark, sf):
    report = mapped(spark, sf).select(
        F.col("scientificName").alias("input_name"), F.lit("Panthera onca").alias("acceptedNameUsage"),
        F.when(F.col("scientificName").isin("Felidae", "Panthera onca"), "synonym").otherwise("accepted").alias("validation_status"),
    )
    return T.synonym_sensitivity(report, threatened(spark))


@query(
    "name_distinct_species",
    with_mapped(
        NAMES_CTE + " SELECT count(DISTINCT coalesce(n.taxon_key, m.scientificName)) AS species FROM mapped m "
        "LEFT JOIN names n ON m.scientificName = n.name WHERE trim(m.scientificName) <> ''"
    ),
)
def name_distinct_species(spark, sf):
    return T.distinct_species(mapped(spark, sf))


# ---- problems ----------------------------------------------------------------------------------

D_SQL = "regexp_matches(eventDate, '^\\d{2}[/.]\\d{2}[/.]\\d{4}$')"
AMB_SQL = (
    f"{D_SQL} AND substr(eventDate, 1, 2) <= '12' AND substr(eventDate, 4, 2) <= '12' AND substr(eventDate, 1, 2) <> substr(eventDate, 4, 2)"
)
PROBLEM_PARTS = [
    "SELECT row_id, 'recordedBy' AS term, 'cell_formula' AS type, recordedBy AS value, '1+1' AS suggestion FROM mapped WHERE recordedBy = '=1+1'",
    "SELECT row_id, 'sex', 'vocab_unknown', sex, CASE sex WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' END FROM mapped WHERE sex IN ('M', 'F', '?')",
    "SELECT row_id, 'occurrenceStatus', 'vocab_unknown', occurrenceStatus, CASE occurrenceStatus WHEN 'visto' THEN 'present' END "
    "FROM mapped WHERE occurrenceStatus IN ('visto', '1')",
    f"SELECT row_id, 'eventDate', CASE WHEN {AMB_SQL} THEN 'date_ambiguous' ELSE 'date_unparsed' END, eventDate, NULL FROM mapped "
    "WHERE eventDate <> '' AND NOT regexp_matches(eventDate, '^\\d{4}-\\d{2}-\\d{2}$')",
    "SELECT row_id, 'individualCount', 'count_invalid', individualCount, CASE individualCount WHEN 'cerca de 10' THEN '10' WHEN '3,0' THEN '3' END "
    "FROM mapped WHERE individualCount IN ('cerca de 10', '3,0', 'muitos')",
    "SELECT row_id, 'individualCount', 'count_present_zero', individualCount, NULL FROM mapped WHERE individualCount = '0' AND occurrenceStatus = 'present'",
    "SELECT row_id, 'coordinateUncertaintyInMeters', 'uncertainty_invalid', coordinateUncertaintyInMeters, CASE coordinateUncertaintyInMeters "
    "WHEN '30 m' THEN '30' WHEN '2 km' THEN '2000' WHEN '1.000' THEN '1000' END FROM mapped WHERE coordinateUncertaintyInMeters IN ('30 m', '2 km', '1.000', '-5')",
    "SELECT row_id, 'measurementValue [area_ha]', CASE \"measurementValue [area_ha]\" WHEN '12 ha' THEN 'measure_unit' ELSE 'measure_number' END, "
    "\"measurementValue [area_ha]\", CASE \"measurementValue [area_ha]\" WHEN '12 ha' THEN '12' ELSE '1.5' END FROM mapped "
    "WHERE \"measurementValue [area_ha]\" IN ('12 ha', '1,5')",
    f"SELECT row_id, 'decimalLatitude', 'coord_zero', decimalLatitude, NULL FROM mapped WHERE {LAT_SQL} = 0 AND {LON_SQL} = 0",
    f"SELECT row_id, 'decimalLongitude', 'coord_zero', decimalLongitude, NULL FROM mapped WHERE {LAT_SQL} = 0 AND {LON_SQL} = 0",
    "SELECT row_id, 'scientificName', CASE scientificName WHEN 'NA' THEN 'name_placeholder' WHEN 'P. onca' THEN 'name_abbreviated' ELSE 'name_hybrid' END, "
    "scientificName, NULL FROM mapped WHERE scientificName IN ('NA', 'P. onca', 'Cebus apella x Sapajus nigritus')",
    "SELECT row_id, 'scientificName', 'required_empty', '', NULL FROM mapped WHERE scientificName = ''",
    "SELECT row_id, 'basisOfRecord', 'required_empty', '', NULL FROM mapped WHERE basisOfRecord = ''",
    "SELECT row_id, 'country', 'country_threat_code', country, NULL FROM mapped WHERE country = 'VU'",
    "SELECT row_id, 'countryCode', 'country_conflict', countryCode, NULL FROM mapped WHERE "
    f"{COUNTRY_SQL.format('country')} <> CASE countryCode WHEN 'BRA' THEN 'BRA' WHEN 'br' THEN 'BRA' WHEN 'AR' THEN 'ARG' WHEN 'ESP' THEN 'ESP' END",
    "SELECT row_id, 'occurrenceID', 'id_duplicate', occurrenceID, NULL FROM mapped WHERE occurrenceID = 'OCC-SHARED' "
    "AND (SELECT count(*) FROM mapped WHERE occurrenceID = 'OCC-SHARED') > 1",
]
PROBLEMS_CTE = ", problems AS (" + " UNION ALL ".join(PROBLEM_PARTS) + ")"
FAMILY_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, (f, _) in P.PROBLEM_TYPES.items()) + " END"
BULK_SQL = "type IN (" + ", ".join(f"'{t}'" for t, (_, b) in P.PROBLEM_TYPES.items() if b) + ")"


def problems(spark, sf):
    return P.detect_problems(mapped(spark, sf), AS_OF_YEAR)


@query(
    "problem_cells",
    with_mapped(PROBLEMS_CTE + f" SELECT row_id, term, type, {FAMILY_SQL} AS family, {BULK_SQL} AS bulk, value, suggestion FROM problems"),
)
def problem_cells(spark, sf):
    return problems(spark, sf).drop("type_rank")


@query("problem_type_counts", with_mapped(PROBLEMS_CTE + " SELECT type, count(*) AS n FROM problems GROUP BY type"))
def problem_type_counts(spark, sf):
    return P.problem_counts(problems(spark, sf))


@query(
    "problem_dominant",
    with_mapped(
        PROBLEMS_CTE + ", top AS (SELECT type, term, count(*) AS n FROM problems GROUP BY type, term ORDER BY n DESC, type, term LIMIT 1) "
        "SELECT type, term, n, n / (SELECT count(*) FROM mapped) AS share FROM top WHERE n >= 20 AND n / (SELECT count(*) FROM mapped) >= 0.2"
    ),
)
def problem_dominant(spark, sf):
    total = mapped(spark, sf).agg(F.count("*").alias("n")).scalar()
    return P.dominant_problem(problems(spark, sf), total)


@query(
    "problem_fix_groups",
    with_mapped(PROBLEMS_CTE + " SELECT term, type, value, '' AS suggestion, count(*) AS n FROM problems GROUP BY term, type, value"),
)
def problem_fix_groups(spark, sf):
    return P.fix_keys(problems(spark, sf))


@query(
    "problem_edits_matched",
    with_mapped(
        PROBLEMS_CTE + " SELECT row_id, term, type, CASE WHEN term = 'sex' AND value = 'M' AND row_id % 100 = 6 THEN row_id "
        "WHEN term = 'sex' AND value = 'M' THEN -1 END AS edit_seq FROM problems"
    ),
)
def problem_edits_matched(spark, sf):
    return P.match_edits(problems(spark, sf), _sex_edits(spark, sf)).select("row_id", "term", "type", "edit_seq")


def _sex_edits(spark, sf):
    single = mapped(spark, sf).filter("row_id % 100 = 6").select(
        "row_id", F.lit("sex").alias("term"), F.lit("M").alias("from"), F.lit("indeterminate").alias("to"), F.col("row_id").alias("seq")
    )
    wide = single.limit(0).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS row_id, 'sex' AS term, 'M' AS `from`, 'male' AS `to`, CAST(-1 AS BIGINT) AS seq"))
    return single.unionByName(wide)


_RARE = (
    "SELECT o_orderkey AS row_id, {term} AS term, {kind} AS type, {value} AS value FROM orders WHERE o_orderkey % 8 = {rest}"
)


def _rare_sql() -> str:
    cases = [
        (0, "eventDate", "interval_inverted", "2003-05-01/2002-01-02"), (1, "eventDate", "year_range", "1200-05-01"),
        (2, "year", "date_mismatch", "2004"), (3, "eventTime", "time_invalid", "8h30"), (4, "decimalLatitude", "coord_invalid", "95.5"),
        (5, "scientificNameAuthorship", "name_authorship", "(Linnaeus, 1771"), (6, "scientificName", "name_multiple", "Aus bus / Cus dus"),
        (7, "scientificName", "name_extra_text", "Aus bus (cultivado)"),
    ]
    quoted = [{"rest": r, "term": f"'{t}'", "kind": f"'{k}'", "value": f"'{v}'"} for r, t, k, v in cases]
    return " UNION ALL ".join(_RARE.format(**q) for q in quoted)


@query("problem_rare_types", _rare_sql())
def problem_rare_types(spark, sf):
    """One cell wrong in each order's record: the types the occurrence table never shows."""
    k = F.col("o_orderkey") % 8
    cell = lambda fine, rest, wrong: F.when(k == rest, wrong).otherwise(fine)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(k == 0, "2003-05-01/2002-01-02").when(k == 1, "1200-05-01").otherwise("2003-05-01").alias("eventDate"),
        F.when(k < 2, "").otherwise(cell("2003", 2, "2004")).alias("year"), cell("08:30", 3, "8h30").alias("eventTime"),
        cell("-10.5", 4, "95.5").alias("decimalLatitude"), F.lit("-50.25").alias("decimalLongitude"),
        F.when(k == 6, "Aus bus / Cus dus").when(k == 7, "Aus bus (cultivado)").otherwise("Aus bus").alias("scientificName"),
        cell("L.", 5, "(Linnaeus, 1771").alias("scientificNameAuthorship"))
    return P.detect_problems(rows, AS_OF_YEAR).select("row_id", "term", "type", "value")


@query(
    "problem_copies_excluded",
    with_mapped(
        PROBLEMS_CTE + " SELECT type, count(*) AS n FROM problems WHERE type <> 'id_duplicate' OR (SELECT count(*) FROM mapped WHERE occurrenceID = 'OCC-SHARED') > 1 GROUP BY type"
    ),
)
def problem_copies_excluded(spark, sf):
    base = mapped(spark, sf)
    kept = W.drop_copy_id_problems(problems(spark, sf), W.exact_copies(base))
    return P.problem_counts(kept)


@query(
    "problem_year_ranges",
    "SELECT count(*) FILTER (year(o_orderdate) > 1998 OR year(o_orderdate) < 1996) AS \"count\", "
    "count(*) FILTER (year(o_orderdate) > 1998) AS future_count, count(*) FILTER (year(o_orderdate) < 1996) AS ancient_count FROM orders",
)
def problem_year_ranges(spark, sf):
    dated = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("eventDate"))
    return P.year_range_counts(dated, 1996, 1998)


@query(
    "problem_unparsed_dates",
    with_mapped("SELECT row_id, 'eventDate' AS term, eventDate AS value FROM mapped WHERE eventDate <> '' AND NOT regexp_matches(eventDate, '^\\d{4}-\\d{2}-\\d{2}$')"),
)
def problem_unparsed_dates(spark, sf):
    return P.unparsed_dates(mapped(spark, sf))


@query("problem_formula_cells", with_mapped("SELECT row_id, 'recordedBy' AS term, recordedBy AS value FROM mapped WHERE recordedBy = '=1+1'"))
def problem_formula_cells(spark, sf):
    return P.formula_cells(mapped(spark, sf))


@query("problem_formula_sample", with_mapped("SELECT row_id, 'recordedBy' AS term, recordedBy AS value FROM mapped WHERE recordedBy = '=1+1' ORDER BY row_id LIMIT 5"))
def problem_formula_sample(spark, sf):
    return P.count_and_sample(P.formula_cells(mapped(spark, sf)))[1]


@query("id_document_uuid")
def id_document_uuid(spark, sf):
    """Identifiers of whole documents: hashing reads every text to its end."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", persistent_id(content_text(["text", "lang"]), F.lit(1)).alias("id"))
