"""The dirty occurrence view every query starts from, derived from `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OCC_BODY = """
SELECT
  k AS row_id,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'OCC-SHARED' ELSE concat('OCC-', CAST(k AS STRING)) END AS tombo,
  CASE k % 12
    WHEN 0 THEN 'Panthera onca' WHEN 1 THEN 'panthera  ONCA' WHEN 2 THEN 'Puma concolor (Linnaeus, 1771)'
    WHEN 3 THEN 'Panthera cf. onca' WHEN 4 THEN 'Felidae' WHEN 5 THEN 'Panthera sp.'
    WHEN 6 THEN 'Cebus apella x Sapajus nigritus' WHEN 7 THEN 'NA' WHEN 8 THEN 'P. onca'
    WHEN 9 THEN '' WHEN 10 THEN 'Euterpe edulis Mart.' ELSE 'Inga nobilis Willd. subsp. nobilis' END AS especie,
  CASE k % 7
    WHEN 0 THEN concat(y, '-', m, '-', d) WHEN 1 THEN concat(d, '/', m, '/', y) WHEN 2 THEN concat(d, '.', m, '.', y)
    WHEN 3 THEN concat(m, '/', y) WHEN 4 THEN '' WHEN 5 THEN 'sem data' ELSE concat(d, '/', m, '/', y, ' 08:30') END AS data_registro,
  concat(CASE WHEN la < 0 THEN '-' ELSE '' END, CAST(CAST(floor(abs(la) / 100) AS BIGINT) AS STRING),
         CASE WHEN k % 5 = 0 THEN ',' ELSE '.' END, lpad(CAST(abs(la) % 100 AS STRING), 2, '0')) AS latitude,
  concat(CASE WHEN lo < 0 THEN '-' ELSE '' END, CAST(CAST(floor(abs(lo) / 100) AS BIGINT) AS STRING),
         CASE WHEN k % 5 = 0 THEN ',' ELSE '.' END, lpad(CAST(abs(lo) % 100 AS STRING), 2, '0')) AS longitude,
  CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'Brasil' WHEN 2 THEN 'BRAZIL' WHEN 3 THEN 'Argentina'
    WHEN 4 THEN 'Brazl' WHEN 5 THEN 'BR' WHEN 6 THEN 'ESP' ELSE 'VU' END AS pais,
  CASE k % 9 WHEN 0 THEN '0' WHEN 1 THEN 'cerca de 10' WHEN 2 THEN '3,0' WHEN 3 THEN 'muitos' WHEN 4 THEN '' ELSE CAST(k % 9 AS STRING) END AS numero_individuos,
  CASE k % 8 WHEN 0 THEN '30 m' WHEN 1 THEN '2 km' WHEN 2 THEN '1.000' WHEN 3 THEN '-5' WHEN 4 THEN '' ELSE '100' END AS incerteza_m,
  CASE k % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'male' WHEN 3 THEN '?' ELSE '' END AS sexo,
  CASE k % 4 WHEN 0 THEN 'visto' WHEN 1 THEN '1' WHEN 2 THEN 'present' ELSE '' END AS status,
  CASE k % 10 WHEN 0 THEN '12 ha' WHEN 1 THEN '1,5' WHEN 2 THEN '' ELSE CAST(k % 50 AS STRING) END AS area_ha,
  CASE WHEN k % 97 = 0 THEN '=1+1' ELSE o_orderpriority END AS coletor
FROM (
  SELECT o_orderkey AS k, o_orderpriority,
         CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m,
         lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d,
         (o_orderkey * 7919) % 18001 - 9000 AS la, (o_orderkey * 104729) % 36001 - 18000 AS lo
  FROM {orders}
) b
"""
OCC_CTE = "WITH occ AS (" + OCC_BODY.replace("{orders}", "orders") + ")"
AS_OF_YEAR = 2026


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OCC_BODY, orders=table(spark, sf_dir, "orders"))


def with_occ(body: str) -> str:
    """SQL over the `occ` view; further CTEs may follow after a leading comma."""
    return OCC_CTE + (body if body.lstrip().startswith(",") else "\n" + body)
