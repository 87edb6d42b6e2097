"""Camera-trap packages: typed tables to a flat occurrence table, and an export normaliser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.text import blank_to_null, text
from quadrat.operators.mapping import non_empty_columns
from quadrat.operators.numbering import first_per_key, number_within

# Column types of the package tables.
DEPLOYMENTS = (
    "deploymentID string, locationID string, locationName string, latitude double, longitude double, "
    "coordinateUncertainty double, deploymentStart string, deploymentEnd string, setupBy string, cameraID string, "
    "cameraModel string, cameraDelay int, cameraHeight double, cameraDepth double, cameraTilt int, cameraHeading int, "
    "detectionDistance double, timestampIssues boolean, baitUse string, featureType string, habitat string, "
    "deploymentGroups string, deploymentTags string, deploymentComments string"
)
MEDIA = (
    "mediaID string, deploymentID string, captureMethod string, timestamp string, filePath string, filePublic boolean, "
    "fileName string, fileMediatype string, exifData string, favorite boolean, mediaComments string"
)
OBSERVATIONS = (
    "observationID string, deploymentID string, mediaID string, eventID string, eventStart string, eventEnd string, "
    "observationLevel string, observationType string, cameraSetupType string, scientificName string, count int, "
    "lifeStage string, sex string, behavior string, individualID string, individualPositionRadius double, "
    "individualPositionAngle double, individualSpeed double, bboxX double, bboxY double, bboxWidth double, "
    "bboxHeight double, classificationMethod string, classifiedBy string, classificationTimestamp string, "
    "classificationProbability double, observationTags string, observationComments string"
)
# Feature types a deployment may name.
FEATURE_TYPES = (
    "roadPaved", "roadDirt", "trailHiking", "trailGame", "roadUnderpass", "roadOverpass", "roadBridge", "culvert",
    "burrow", "nestSite", "carcass", "waterSource", "fruitingTree",
)
TIMESTAMP_FORMS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
)


def parse_timestamp(value: Column | str) -> Column:
    """One of four exact forms to ISO text, NULL when it does not read back identically."""
    v = text(value)
    tries = []
    for pattern, form in TIMESTAMP_FORMS:
        ts = F.try_to_timestamp(v, F.lit(form))
        tries.append(F.when(v.rlike(pattern), F.when(F.date_format(ts, form) == v, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))))
    return F.coalesce(*tries)


def end_of_day(value: Column | str) -> Column:
    """A bare end date covers its whole day."""
    return F.regexp_replace(text(value), r"^(\d{4}-\d{2}-\d{2})( 00:00(:00)?)?$", "$1 23:59:59")


def lost_timestamps(raw: Column, parsed: Column) -> Column:
    """Aggregate: filled values that could not be read."""
    return F.count_if((text(raw) != "") & parsed.isNull())


def without_zone(value: Column) -> Column:
    return F.replace(value, F.lit("Z"), F.lit(""))


def observation_type(blank: Column, genus: Column, species: Column, family: Column, order: Column, class_: Column, common: Column) -> Column:
    none = reduce(lambda a, b: a & b, [text(c) == "" for c in (class_, order, family, genus, species)])
    return (
        F.when(F.lower(text(blank)).isin("1", "true"), "blank")
        .when(genus == "Homo", "human")
        .when((class_ == "Vehicle") | common.rlike("[Vv]ehicle"), "vehicle")
        .when(none, "unknown")
        .otherwise("animal")
    )


def observed_name(genus: Column, species: Column, family: Column, order: Column, class_: Column) -> Column:
    g, s = F.nullif(genus, F.lit("")), F.nullif(species, F.lit(""))
    rest = [F.nullif(c, F.lit("")) for c in (family, order, class_)]
    return F.coalesce(F.concat(g, F.lit(" "), s), g, *rest)


def allowed(value: Column, values: tuple[str, ...]) -> Column:
    return F.when(value.isin(*values), value)


def feature_type(value: Column) -> Column:
    """`Road paved` to `roadPaved`, only known types."""
    words = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda w: w != "")
    camel = F.concat(F.get(words, F.lit(0)), F.array_join(F.transform(F.slice(words, 2, 100), lambda w: F.initcap(w)), ""))
    return allowed(camel, FEATURE_TYPES)


def observation_ids(observations: DataFrame, order: str = "seq") -> DataFrame:
    """Number the observations of each event and build their identifiers."""
    numbered = number_within(observations, ["eventID"], "__n", order)
    return numbered.withColumn("observationID", F.concat("eventID", F.lit("-obs-"), F.col("__n").cast("string"))).drop("__n")


def read_package(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deployments, media, observations) of an unpacked package; columns are matched by name."""
    def load(name: str, types: str) -> DataFrame:
        raw = spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=False, multiLine=True, escape='"')
        wanted = [part.strip().split(" ") for part in types.split(",")]
        missing = F.lit(None).cast("string")
        return raw.select(*[(F.col(f"`{n}`") if n in raw.columns else missing).try_cast(t).alias(n) for n, t in wanted])

    return load("deployments", DEPLOYMENTS), load("media", MEDIA), load("observations", OBSERVATIONS)


def occurrences(deployments: DataFrame, media: DataFrame, observations: DataFrame) -> DataFrame:
    """Flat occurrence table of the animal observations; columns that are empty throughout are dropped."""
    place = deployments.select(
        "deploymentID", "locationID", "locationName", "latitude", "longitude", "coordinateUncertainty", "habitat", "deploymentStart", "deploymentEnd"
    )
    files = media.select("mediaID", "filePath")
    animals = observations.filter((F.col("observationType") == "animal") & (text("scientificName") != ""))
    joined = animals.join(place, "deploymentID").join(files, "mediaID", "left")
    when = F.when(
        F.col("eventEnd").isNull() | (F.col("eventEnd") == F.col("eventStart")), F.col("eventStart")
    ).otherwise(F.concat("eventStart", F.lit("/"), "eventEnd"))
    flat = joined.select(
        F.col("observationID").alias("occurrenceID"), F.lit("MachineObservation").alias("basisOfRecord"), "eventID",
        F.col("deploymentID").alias("parentEventID"), when.alias("eventDate"), "scientificName",
        F.col("count").cast("string").alias("individualCount"), "sex", "lifeStage", "behavior", F.col("individualID").alias("organismID"),
        F.lit("present").alias("occurrenceStatus"), "locationID", F.col("locationName").alias("locality"),
        F.col("latitude").cast("string").alias("decimalLatitude"), F.col("longitude").cast("string").alias("decimalLongitude"),
        F.lit("EPSG:4326").alias("geodeticDatum"), F.col("coordinateUncertainty").cast("string").alias("coordinateUncertaintyInMeters"),
        "habitat", F.col("classifiedBy").alias("identifiedBy"), F.col("filePath").alias("associatedMedia"),
        F.col("observationComments").alias("occurrenceRemarks"),
    )
    kept = non_empty_columns(flat, flat.columns)
    if not kept:
        raise ValueError("the package holds no animal observation")
    return flat.select(*kept)


def read_parts(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """Split files of one table, united by name; each part must have the required columns."""
    parts = [spark.read.csv(p, header=True, inferSchema=False, multiLine=True, escape='"') for p in paths]
    for path, part in zip(paths, parts, strict=True):
        lacking = [c for c in required if c not in part.columns]
        if lacking:
            raise ValueError(f"{path} lacks {', '.join(lacking)}")
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return united.withColumns({c: F.when(F.col(c) != "NA", F.col(c)) for c in united.columns if c not in ("deployment_id", "image_id")})


def normalise_export(
    deployments: DataFrame, images: DataFrame, cameras: DataFrame | None = None, sequences: DataFrame | None = None, order: str = "seq"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A camera-platform export as (deployments, media, observations). With `sequences` observations are
    per sequence, else per image. `order` is a unique number of the source row."""
    def pick(df: DataFrame, name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    base = deployments
    model = F.lit(None).cast("string")
    if cameras is not None:
        side = cameras.select(F.col("camera_id"), F.trim(F.concat_ws(" ", pick(cameras, "make"), "model")).alias("__model")).groupBy("camera_id").agg(F.min("__model").alias("__model"))
        base, model = base.join(side, "camera_id", "left"), F.col("__model")
    dep = base.select(
        F.col("deployment_id").alias("deploymentID"), pick(base, "placename").alias("locationName"),
        F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        parse_timestamp("start_date").alias("deploymentStart"), parse_timestamp(end_of_day("end_date")).alias("deploymentEnd"),
        pick(base, "recorded_by").alias("setupBy"), pick(base, "camera_id").alias("cameraID"), model.alias("cameraModel"),
        feature_type(pick(base, "feature_type")).alias("featureType"), pick(base, "subproject_name").alias("deploymentGroups"),
        pick(base, "remarks").alias("deploymentComments"),
    )
    firsts = first_per_key(images, ["image_id"], [F.col(order)])
    media = firsts.select(
        F.col("image_id").alias("mediaID"), F.col("deployment_id").alias("deploymentID"), parse_timestamp("timestamp").alias("timestamp"),
        pick(firsts, "location").alias("filePath"), pick(firsts, "filename").alias("fileName"),
        F.lower(F.coalesce(pick(firsts, "highlighted"), F.lit(""))).isin("true", "1", "t").alias("favorite"),
    )
    src = images if sequences is None else sequences
    event = F.col("image_id") if sequences is None else F.col("sequence_id")
    count = pick(src, "number_of_objects" if sequences is None else "group_size").try_cast("int")
    taxa = {c: pick(src, c) for c in ("genus", "species", "family", "order", "class")}
    probability = pick(src, "cv_confidence").try_cast("double")
    percent = F.coalesce(src.agg((F.max(probability) > 1).alias("p")).scalar(), F.lit(False))
    obs = src.select(
        F.col(order), event.alias("eventID"), F.col("deployment_id").alias("deploymentID"),
        (F.col("image_id") if sequences is None else F.lit(None).cast("string")).alias("mediaID"),
        parse_timestamp("timestamp" if sequences is None else "start_time").alias("eventStart"),
        parse_timestamp("timestamp" if sequences is None else "end_time").alias("eventEnd"),
        F.lit("media" if sequences is None else "event").alias("observationLevel"),
        observation_type(pick(src, "is_blank"), taxa["genus"], taxa["species"], taxa["family"], taxa["order"], taxa["class"], pick(src, "common_name")).alias("observationType"),
        observed_name(taxa["genus"], taxa["species"], taxa["family"], taxa["order"], taxa["class"]).alias("scientificName"),
        F.coalesce(count, F.lit(1)).alias("count"), allowed(F.lower(pick(src, "age")), ("adult", "subadult", "juvenile")).alias("lifeStage"),
        allowed(F.lower(pick(src, "sex")), ("female", "male")).alias("sex"), blank_to_null(pick(src, "identified_by")).alias("classifiedBy"),
        F.when(pick(src, "identified_by") == "Computer Vision", "machine").otherwise("human").alias("classificationMethod"),
        F.when(percent, probability / 100).otherwise(probability).alias("classificationProbability"),
    )
    return dep, media, observation_ids(obs, order).drop(order)


def single_project_type(projects: DataFrame) -> str | None:
    """The one project type of an export; mixed types are an error."""
    kinds = [r[0] for r in projects.select(F.lower(text("project_type")).alias("t")).filter("t <> ''").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError("the export mixes project types")
    return kinds[0] if kinds else None
