"""Scientific names put together from known parts are taken apart again, and single spellings as listed."""

from itertools import product

from quadrat.functions.names import query_name, with_parts

GENERA = ("Puma", "Inga", "Typhlotanais")
EPITHETS = ("concolor", "novo-mundi", "vera")
AUTHORS = ("", "L.", "(Linnaeus, 1771)", "Müll. Arg.", "van der Werff", "da Silva & Souza, 1990", "(Aubl.) Knobl.", "G. O. Sars, 1882",
           "O'Brien", "de Candolle ex Benth.")
RANKS = {"subsp.": "subspecies", "ssp.": "subspecies", "var": "variety", "f.": "form", "forma": "form"}
SHOWN = {"subspecies": "subsp.", "variety": "var.", "form": "f."}


def made():
    """Spelling -> (canonical name, rank, last epithet, author, qualifier)."""
    out = {}
    for genus, author in product(GENERA, AUTHORS):
        out[f"{genus} {author}".strip()] = (genus, "genus", None, author or None, None)
    for genus, epithet, author in product(GENERA, EPITHETS, AUTHORS):
        species = f"{genus} {epithet}"
        out[f"{species} {author}".strip()] = (species, "species", None, author or None, None)
        out[f"{genus} cf. {epithet} {author}".strip()] = (species, "species", None, author or None, "cf.")
        out[f"{genus} (Subgenus) {epithet} {author}".strip()] = (species, "species", None, author or None, None)
    for mark, author in product(RANKS, AUTHORS):
        rank = RANKS[mark]
        name = f"Inga vera {SHOWN[rank]} minor"
        out[f"Inga vera {mark} minor {author}".strip()] = (name, rank, "minor", author or None, None)
        out[f"Inga vera Willd. {mark} minor {author}".strip()] = (name, rank, "minor", author or "Willd.", None)
        out[f"  Inga  vera {mark} minor ?"] = (name, rank, "minor", None, "?")
    for mark in ("sp.", "spp", "sp. nov. 1"):
        out[f"Inga {mark}"] = ("Inga", "genus", None, None, mark)
    return out


# Spellings with the canonical name and the name to look up.
LISTED = {
    "PUMA CONCOLOR": ("Puma concolor", "Puma concolor"), "Mimus Saturninus": ("Mimus saturninus", "Mimus saturninus"),
    "Dasypus septemcinctus hybridus": ("Dasypus septemcinctus hybridus",) * 2, "Panthera Oken, 1816": ("Panthera", "Panthera"),
    "Panthera onca cf": ("Panthera onca", "Panthera onca"), "indet. Panthera onca": ("Panthera onca", "Panthera onca"),
    "Panthera onca.": ("Panthera onca", "Panthera onca"), "Tangara araraúna": ("Tangara ararauna", "Tangara ararauna"),
    "Felidae": ("Felidae", "Felidae"), "Brignolia DC.": ("Brignolia", "Brignolia"),
    "Sapium biglandulosum var. pallidum f. oblongifolium Müll. Arg.": ("Sapium biglandulosum var. pallidum f. oblongifolium",) * 2,
    "Phasma (Craspedonia) Westwood, 1841": ("Phasma", "Phasma"), "Leptodictyum (Schimp.) Warnst.": ("Leptodictyum", "Leptodictyum"),
    "Arrenurus (Incertae sedis) acutiepimeratus Viets, 1954": ("Arrenurus acutiepimeratus",) * 2,
    "Cornurella fonsecae da Silva, da Silva, Esteves & Decraemer, 2017": ("Cornurella fonsecae",) * 2,
    "Schochia Brunner von Wattenwyl, 1895": ("Schochia", "Schochia"), "Panthera sp.": ("Panthera", None),
    "Panthera onca juvenile": (None, "Panthera onca"), "Panthera onca (cultivado)": (None, "Panthera onca"),
    "Scinax 1": (None, "Scinax"), "Panthera x leo": (None, None), "Panthera onca / Puma concolor": (None, None), "P. onca": (None, None),
    "NA": (None, None), "": (None, None), "sp. 1": (None, None), "Puma concolor (L., 1771": ("Puma concolor", "Puma concolor"),
}


def test_names_from_known_parts(spark):
    want = made()
    assert len(want) > 200
    rows = with_parts(spark.createDataFrame([(n,) for n in want], "name string"), "name").collect()
    fields = ("canonicalName", "taxonRank", "infraspecificEpithet", "scientificNameAuthorship", "identificationQualifier")
    assert {r["name"]: tuple(r["parts"][f] for f in fields) for r in rows} == want


def test_listed_names_and_their_query(spark):
    df = with_parts(spark.createDataFrame([(n,) for n in LISTED] + [(None,)], "name string"), "name")
    rows = df.select("name", "parts.canonicalName", query_name(df["parts"]).alias("q"), "parts.nameIssue").collect()
    assert {r["name"]: (r["canonicalName"], r["q"]) for r in rows} == LISTED | {None: (None, None)}
    assert {r["nameIssue"] for r in rows if r["name"] == "Puma concolor (L., 1771"} == {"authorship"}


def test_no_python_worker_in_the_plan(spark):
    plan = with_parts(spark.createDataFrame([("Puma concolor",)], "name string"), "name")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
