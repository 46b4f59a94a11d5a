from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from samples import topic, work

from pubmart.operators import checks as C
from pubmart.operators import profile as P
from pubmart.operators import reshape as R
from pubmart.operators import sample as S
from pubmart.operators.keys import ordered_keys
from pubmart.operators.merge import merge_entities
from pubmart.plans.load import extract_panel, extract_sample, load_reconciled, read_manifest, sample_manifest
from pubmart.schemas import COUNTRY_RECORD, INDICATORS, SAMPLE_SEED, YEARS
from pubmart.session import shuffles_removed, stored
from pubmart.sources import landed as L
from pubmart.sources import sinks
from pubmart.sources.records import read_works
from pubmart.sources.releases import current_version, table_path

# Qualifying works per year and their shares of a sample of 50,000.
POPULATION = dict(zip(YEARS, (135061, 149177, 161895, 171702, 168366, 196327, 225986, 278602)))
SHARES = dict(zip(YEARS, (4541, 5016, 5443, 5773, 5661, 6601, 7598, 9367)))


def violations(checks) -> dict[str, int]:
    return {row["check"]: row.violations for row in checks.collect() if row.violations}


def test_allocation(spark):
    population = spark.createDataFrame(list(POPULATION.items()), "year INT, population BIGINT")
    allocation = S.allocate(population)
    assert {r.year: r.allocation for r in allocation.collect()} == SHARES
    assert violations(S.allocation_checks(allocation)) == {}
    assert violations(S.allocation_checks(S.allocate(population, 80_000), 80_000)) == {}
    limited = S.allocation_checks(S.allocate(population, 80_000), 80_000, limit=10_000)
    assert violations(limited) == {"stratum limit": 3}
    too_many = S.allocation_checks(S.allocate(population, 2_000_000), 2_000_000)
    assert "target within population" in violations(too_many)
    assert violations(S.population_checks(population.where("year <> 2020"))) == {"stratum not empty": 1}
    ties = spark.createDataFrame([(2019, 1), (2018, 1), (2020, 1)], "year INT, population BIGINT")
    assert {r.year: r.allocation for r in S.allocate(ties, 2).collect()} == {2018: 1, 2019: 1, 2020: 0}
    with pytest.raises(ValueError):
        S.allocate(population, 0)


def test_sample_equals_brute_force(spark):
    works = [(f"W{i}", 2018 if i % 3 else 2019) for i in range(3000)]
    corpus = spark.createDataFrame(works, "work_id STRING, publication_year INT")
    allocation = spark.createDataFrame([(2018, 211), (2019, 7)], "year INT, allocation BIGINT")
    drawn = {(r.year, r.work_id) for r in S.sample_ids(corpus, allocation, seed=5).collect()}

    def first(year: int, n: int) -> set:
        ids = [w for w, y in works if y == year]
        return set(sorted(ids, key=lambda w: (hashlib.md5(f"{year + 5}:{w}".encode()).hexdigest(), w))[:n])

    assert drawn == {(2018, w) for w in first(2018, 211)} | {(2019, w) for w in first(2019, 7)}


def test_reject_reasons(spark, write_lines):
    good = topic(1, "Vision")
    elsewhere = {**good, "subfield": {"id": "https://ids.example/subfields/9", "display_name": "Other"}}
    variants = {
        None: {},
        "invalid_work_id": {"id": "https://ids.example/X1"},
        "publication_year": {"publication_year": 2017, "publication_date": "2017-01-01"},
        "publication_date": {"publication_date": None},
        "publication_date_year_mismatch": {"publication_year": 2023},
        "work_type": {"type": "dataset"},
        "retracted_or_unknown": {"is_retracted": None},
        "primary_topic": {"primary_topic": None},
        "primary_topic_subfield": {"primary_topic": elsewhere},
        "topics": {"topics": []},
        "primary_topic_relationship": {"topics": [topic(2, "Language")]},
    }
    records = [work(i, **change) for i, change in enumerate(variants.values())]
    works = read_works(spark, write_lines("works.jsonl", records))
    found = [r.reason for r in works.select("work_id", S.reject_reason().alias("reason")).collect()]
    assert sorted(map(str, found)) == sorted(map(str, variants))
    # The corpus filter looks at subfield, year, type and retraction only.
    assert works.where(S.in_corpus()).count() == 6


def sample_records(**last) -> list[dict]:
    days = ["2018-05-01"] * 4 + ["2019-05-01"] * 2
    records = [work(i, day) for i, day in enumerate(days)]
    records[-1].update(last)
    return records


def test_sample_is_published_with_its_manifest(spark, tmp_path, write_lines):
    root = str(tmp_path / "sample")
    path = write_lines("works.jsonl", [*sample_records(), work(9, "2018-01-01", is_retracted=True)])
    lines = extract_sample(spark, path, root, target=4, years=(2018, 2019))
    years = sorted(json.loads(r.value)["publication_year"] for r in lines.collect())
    assert years == [2018, 2018, 2018, 2019]
    manifest = spark.read.json(table_path(root, 1, "manifest")).first()
    assert (manifest.actual_total, manifest.duplicate_count, manifest.guardrail_failures) == (4, 0, 0)
    assert manifest.digest == sinks.rows_digest(lines).first().digest
    assert manifest.qualifying_population == 6

    panel = write_lines("panel.jsonl", [{"country_code_iso2": "IT", "country_code_iso3": "ITA", "year": 2018}])
    sample = table_path(root, 1, "sample")
    tables = load_reconciled(spark, sample, panel, str(tmp_path / "r"), table_path(root, 1, "manifest"))
    assert tables["r_work"].count() == 4
    assert read_manifest(spark, table_path(root, 1, "manifest"))["digest"] == manifest.digest


def test_bad_sample_keeps_the_published_version(spark, tmp_path, write_lines):
    root = str(tmp_path / "sample")
    extract_sample(spark, write_lines("a.jsonl", sample_records()), root, target=4, years=(2018, 2019))
    # The only work of a stratum names no related topic: the corpus filter keeps it, a guardrail not.
    unrelated = [*sample_records()[:4], work(5, "2019-05-01", topics=[topic(2, "Language")])]
    with pytest.raises(C.CheckFailed, match="absent from topics .1."):
        extract_sample(spark, write_lines("b.jsonl", unrelated), root, target=5, years=(2018, 2019))
    with pytest.raises(C.CheckFailed, match="stratum not empty"):
        extract_sample(spark, write_lines("c.jsonl", sample_records()), root, target=4, years=(2018, 2020))
    copies = [*sample_records(), work(0, "2018-05-01")]
    with pytest.raises(C.CheckFailed, match="target within population"):
        extract_sample(spark, write_lines("d.jsonl", copies), root, target=7, years=(2018, 2019))
    assert current_version(spark, root) == 1


def test_sample_of_works_with_copies(spark, tmp_path, write_lines):
    retracted = [{**r, "is_retracted": True} for r in sample_records()]
    again = {**sample_records()[0], "title": "Work 0 again", "display_name": "Work 0 again"}
    tab = {**work(7, "2019-05-02"), "id": "\thttps://ids.example/W7 "}
    records = [*sample_records(), *retracted, sample_records()[1], again, tab]
    root = str(tmp_path / "sample")
    lines = extract_sample(spark, write_lines("w.jsonl", records), root, target=7, years=(2018, 2019))
    found = [json.loads(r.value) for r in lines.collect()]
    assert sorted(r["id"].strip()[-2:] for r in found) == [f"W{i}" for i in (0, 1, 2, 3, 4, 5, 7)]
    assert not any(r["is_retracted"] for r in found)
    manifest = spark.read.json(table_path(root, 1, "manifest")).first()
    assert (manifest.actual_total, manifest.qualifying_population, manifest.further_lines_of_chosen_corpus) == (7, 7, 2)
    assert manifest.complete and {(y.year, y.works, y.seed) for y in manifest.actual_by_year} == {
        (2018, 4, SAMPLE_SEED + 2018),
        (2019, 3, SAMPLE_SEED + 2019),
    }


def test_sample_names_bad_lines(spark, tmp_path, write_lines):
    root = str(tmp_path / "sample")
    records = [*sample_records(), "{broken", {**work(8, "2018-01-01"), "cited_by_count": "many"}]
    with pytest.raises(C.CheckFailed, match="2 of 8 works records.*malformed JSON object"):
        extract_sample(spark, write_lines("w.jsonl", records), root, target=4, years=(2018, 2019))
    assert current_version(spark, root) == 0


def test_manifest_counts_what_the_lines_hold(spark, write_lines):
    records = [*sample_records()[:3], sample_records()[2], work(8, "2018-02-02", is_retracted=True)]
    path = write_lines("w.jsonl", records)
    population = spark.createDataFrame([(2018, 9)], "year INT, population BIGINT")
    allocation = spark.createDataFrame([(2018, 5)], "year INT, allocation BIGINT")
    row = sample_manifest(spark.read.text(path), read_works(spark, path), population, allocation, 5, 1, (2018,)).first()
    assert (row.actual_total, row.duplicate_count, row.guardrail_failures, row.complete) == (5, 1, 1, False)


def test_large_strata_are_sampled(spark):
    corpus = spark.range(60_000).selectExpr("concat('W', id) AS work_id", "2018 + cast(id % 2 AS INT) AS publication_year")
    allocation = S.allocate(S.population_by_year(corpus), 40_000)
    assert violations(S.allocation_checks(allocation, 40_000)) == {}
    ids = S.sample_ids(corpus, allocation, seed=3)
    assert {(r.year, r["count"]) for r in ids.groupBy("year").count().collect()} == {(2018, 20_000), (2019, 20_000)}
    assert ids.distinct().count() == 40_000


def page(number: int, pages: int, total, records) -> str:
    return json.dumps([{"page": number, "pages": pages, "per_page": 2, "total": total}, records])


def pages_frame(spark, *values: str):
    return L.parse_pages(spark.createDataFrame([("data", v) for v in values], "endpoint STRING, value STRING"))


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([page(1, 2, 2, [{"id": "a"}]), page(2, 2, 2, [{"id": "b"}])], {}),
        ([page(1, 1, 0, None)], {}),
        ([page(1, 2, 2, [{"id": "a"}])], {"pages complete": 1, "declared records": 1}),
        ([page(1, 1, 3, [{"id": "a"}])], {"declared records": 1}),
        ([page(1, 2, 2, [{"id": "a"}]), page(2, 3, 2, [{"id": "b"}])], {"page count constant": 1, "pages complete": 1}),
        (['{"message": "no"}'], {"page shape": 1, "pages complete": 1}),
        ([page(1, 1, 1, ["text"])], {"page shape": 1}),
    ],
)
def test_landed_pages(spark, values, expected):
    assert violations(L.page_checks(pages_frame(spark, *values))) == expected


def test_countries(spark):
    records = L.page_records(
        pages_frame(
            spark,
            page(
                1,
                1,
                3,
                [
                    {"id": "WLD", "iso2Code": "1W", "name": "World", "region": {"id": "NA", "value": "Aggregates"}},
                    {"id": "ITA ", "iso2Code": "IT", "name": "Italy", "region": {"id": "ECS", "value": "Europe"}},
                    {"id": "DEU", "iso2Code": "DE", "name": None, "region": None},
                ],
            ),
        ),
        COUNTRY_RECORD,
    )
    real, aggregates = L.split_countries(records)
    assert [(r.country_code_iso3, r.country_name) for r in real.collect()] == [("DEU", ""), ("ITA", "Italy")]
    assert aggregates.count() == 1
    doubled = real.unionAll(real)
    assert violations(L.country_checks(doubled)) == {"duplicate key": 2}


@pytest.fixture
def landing(tmp_path):
    def write(observations, names: dict | None = None) -> str:
        root = tmp_path / "landed"
        endpoints = {
            "country": [
                {"id": "WLD", "iso2Code": "1W", "name": "World", "region": {"id": "NA", "value": "Aggregates"}},
                {"id": "ITA", "iso2Code": "IT", "name": "Italy", "region": {"id": "ECS", "value": "Europe"}, "incomeLevel": {"id": "HIC", "value": "High income"}},
                {"id": "DEU", "iso2Code": "DE", "name": "Germany", "region": {"id": "ECS", "value": "Europe"}, "incomeLevel": {"id": "HIC", "value": "High income"}},
            ],
            "source": [{"id": "2", "name": "World Development Indicators"}],
            "indicator": [
                {"id": code, "name": (names or {}).get(code, f"Name of {code}"), "source": {"id": "2", "value": "W"}}
                for code in INDICATORS.values()
            ],
            "data": observations,
        }
        for endpoint, records in endpoints.items():
            folder = root / endpoint
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "page-1.json").write_text(page(1, 1, len(records), records))
        return str(root)

    return write


def observed(code: str, iso3: str, year, value) -> dict:
    return {"indicator": {"id": code, "value": "x"}, "countryiso3code": iso3, "date": str(year), "value": value}


def test_panel_extraction(spark, tmp_path, landing):
    observations = [
        observed("SP.POP.TOTL", "ITA", 2018, 60),
        observed("SP.POP.TOTL", "DEU", 2019, None),
        observed("IT.NET.USER.ZS", "DEU", 2019, 120.5),
        observed("SP.POP.TOTL", "WLD", 2018, 1),
        observed("SP.POP.TOTL", "ITA", 1990, 1),
        observed("XX", "ITA", 2018, 1),
    ]
    root = str(tmp_path / "out")
    panel = extract_panel(spark, landing(observations), root)
    assert panel.count() == 16
    italy = panel.where("country_code_iso3 = 'ITA' and year = 2018").first()
    assert (italy.population, italy.gdp_current_usd, italy.country_name) == (60.0, None, "Italy")
    manifest = spark.read.json(table_path(root, 1, "manifest")).first()
    assert (manifest.entities_returned, manifest.countries_retained, manifest.aggregates_excluded) == (3, 2, 1)
    assert {(o.status, o.observations) for o in manifest.observations} == {
        ("applied", 3),
        ("not_a_country", 1),
        ("out_of_period", 1),
        ("unexpected_indicator", 1),
    }
    quality = spark.read.json(table_path(root, 1, "quality")).first()
    assert (quality.country_count, quality.row_count, quality.expected_rows) == (2, 16, 16)
    assert (quality.all_null_rows, quality.duplicate_rows) == (14, 0)
    assert [(o.field, o["values"]) for o in quality.out_of_range] == [("internet_users_pct", 1)]
    listed = {name: [tuple(r) for r in spark.read.json(table_path(root, 1, f"quality_{name}")).collect()] for name in P.quality_lists(panel)}
    assert listed["out_of_range"] == [("DEU", "internet_users_pct", 120.5, 2019)]
    assert len(listed["all_null_rows"]) == 14 and ("DEU", 2018) in listed["all_null_rows"] and ("DEU", 2019) not in listed["all_null_rows"]
    assert ("ITA", "internet_users_pct") in listed["countries_without_values"] and len(listed["countries_without_values"]) == 8
    assert manifest.unexpected_indicator_count == 1
    assert [tuple(u) for u in manifest.unexpected_indicators] == [("XX", 1)]
    parts = sorted(Path(table_path(root, 1, "panel")).glob("part-*.json"))
    keys = [(r["country_code_iso3"], r["year"]) for p in parts for r in map(json.loads, p.read_text().splitlines())]
    assert keys == sorted(keys) and len(keys) == 16


@pytest.mark.parametrize(
    ("extra", "names", "expected"),
    [
        ([observed("SP.POP.TOTL", "ITA", 2018, None)], None, "duplicate"),
        ([observed("SP.POP.TOTL", "DEU", 2018, "many")], None, "not_numeric"),
        ([observed("SP.POP.TOTL", "DEU", "20x8", 1)], None, "bad_year"),
        ([], {"SP.POP.TOTL": " "}, "official name"),
    ],
)
def test_bad_panel_is_not_published(spark, tmp_path, landing, extra, names, expected):
    root = str(tmp_path / "out")
    with pytest.raises(C.CheckFailed, match=expected):
        extract_panel(spark, landing([observed("SP.POP.TOTL", "ITA", 2018, 60), *extra], names), root)
    assert current_version(spark, root) == 0


def test_panel_checks(spark):
    countries = spark.createDataFrame([("ITA",), ("DEU",)], "country_code_iso3 STRING")
    panel = R.build_skeleton(countries, (2018, 2019))
    assert violations(P.panel_checks(panel, countries, (2018, 2019))) == {}
    assert violations(P.panel_checks(panel.where("year = 2018"), countries, (2018, 2019))) == {"complete grid": 2}
    strange = panel.unionAll(spark.createDataFrame([("WLD", 2018)], panel.schema))
    assert violations(P.panel_checks(strange, countries, (2018, 2019))) == {"known country": 1}


def test_ordered_keys_are_dense_and_ordered(spark):
    rows = spark.range(0, 5000).selectExpr("concat('k', lpad((id * 7919) % 5000, 5, '0')) as nk")
    keyed = ordered_keys(rows.repartition(7), ("nk",), "key").collect()
    assert [r.key for r in sorted(keyed, key=lambda r: r.nk)] == list(range(1, 5001))


def test_merge_is_independent_of_order(spark):
    schema = "id INT, a STRING, b BIGINT"
    parts = [(1, None, 5), (1, "x", None), (2, "y", 1), (2, "z", 1), (1, "x", 5)]
    for order in (parts, parts[::-1]):
        found = {r.id: tuple(r) for r in merge_entities(spark.createDataFrame(order, schema), ("id",), ("id", "a", "b")).collect()}
        assert found[1] == (1, "x", 5, []) and found[2][3] == ["a"]


def test_digest(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) as v")
    digest = sinks.rows_digest(rows).first()
    assert sinks.rows_digest(rows.repartition(9).orderBy("v")).first() == digest
    assert sinks.rows_digest(rows.unionAll(rows.limit(1))).first().digest != digest.digest
    sinks.verify_rows(rows, digest.digest)
    with pytest.raises(sinks.ChecksumMismatch):
        sinks.verify_rows(rows.limit(99), digest.digest)
    # a value and a NULL, or a border between values, are not mistaken for one another
    pair = lambda *r: sinks.rows_digest(spark.createDataFrame([r], "a string, b string")).first().digest
    assert len({pair("-", None), pair(None, "-"), pair("1:a", "b"), pair("1", "a:b"), pair("", None), pair(None, "")}) == 6
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "v"]


def test_files_are_digested_in_splits(spark, tmp_path):
    """A map of many files; the digest of a file does not depend on its splits; every kind of damage is named."""
    folder = tmp_path / "data"
    lines = {f"part-{i}.jsonl": [f'{{"n": {i}, "k": {k}}}' for k in range(i * 400)] for i in range(1, 6)}
    (folder / "below").mkdir(parents=True)
    lines["below/a b.jsonl"] = ["x", "x", "", "y"]
    for name, rows in lines.items():
        (folder / name).write_text("".join(r + "\n" for r in rows))
    read = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    found = {}
    for settings in ({}, read):
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            files = sinks.file_digests(spark, str(folder))
            found[len(settings)] = ({r.file: (r.row_count, r.digest) for r in files.collect()}, sinks.tree_digest(files).first())
        finally:
            for key in settings:
                spark.conf.unset(key)
    assert found[0] == found[2]
    map_, tree = found[0]
    assert {name: n for name, (n, _) in map_.items()} == {name: len(rows) for name, rows in lines.items() if "/" not in name}
    recorded = {name: digest for name, (_, digest) in map_.items()}
    sinks.verify_files(spark, str(folder), recorded)
    (folder / "part-1.jsonl").write_text("".join(r + "\n" for r in lines["part-1.jsonl"][1:]))
    (folder / "part-2.jsonl").unlink()
    (folder / "part-9.jsonl").write_text("new\n")
    wrong = {r.file: r.problem for r in sinks.differing_files(spark, str(folder), recorded).collect()}
    assert wrong == {"part-1.jsonl": "differs", "part-2.jsonl": "missing", "part-9.jsonl": "not recorded"}
    with pytest.raises(sinks.ChecksumMismatch, match="part-2.jsonl missing"):
        sinks.verify_files(spark, str(folder), recorded)
    assert sinks.tree_digest(sinks.file_digests(spark, str(folder))).first().digest != tree.digest


def test_merge_sorts_contested_rows_only(spark, tmp_path):
    """Copies and settled keys meet hash aggregations; a sorting one reads contested keys alone."""
    path = str(tmp_path / "entities")
    spark.range(2000).selectExpr("concat('k', id % 500) AS id", "if(id % 500 < 5 AND id > 1000, 'other', concat('n', id % 500)) AS a", "if(id % 2 = 0, 'b', null) AS b").write.parquet(path)
    merged = merge_entities(spark.read.parquet(path), ("id",), ("id", "a", "b"))
    assert merged.count() == 500 and merged.where("size(conflicts) > 0").count() == 5
    assert merged.where("id = 'k2'").first().conflicts == ["a"] and merged.where("id = 'k100'").first().b == "b"
    plan = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    sorting = [i for i, line in enumerate(plan) if "SortAggregate" in line]
    joins = [i for i, line in enumerate(plan) if "LeftSemi" in line]
    scans = [i for i, line in enumerate(plan) if "FileScan" in line]
    # below every sorting aggregation the next branch is the semi-join with the contested keys
    assert sorting and all(any(i < j < min(s for s in scans if s > i) for j in joins) for i in sorting)
    none = spark.createDataFrame([(None, "x", None), (None, None, "y"), (None, "x", None)], "id string, a string, b string")
    assert [tuple(r) for r in merge_entities(none, ("id",), ("id", "a", "b")).collect()] == [(None, "x", "y", [])]


def test_merge_of_numbers_takes_one_shuffle(spark, tmp_path):
    """Values of fixed width are merged in one hash aggregation; copies, NULLs and contradictions as for texts."""
    path = str(tmp_path / "pairs")
    rows = [("w", "t", 1, 0.5), ("w", "t", 1, 0.5), ("w", "u", None, None), ("w", "u", 2, None), ("x", "t", 1, 0.25), ("x", "t", 3, 0.25)]
    rows += [(None, "t", 4, None), (None, "t", None, 1.0), ("y", "t", 1, float("nan")), ("y", "t", 1, 0.5), ("z", "t", None, -0.0)]
    spark.createDataFrame(rows, "work STRING, topic STRING, rank INT, score DOUBLE").write.parquet(path)
    merged = merge_entities(spark.read.parquet(path), ("work", "topic"), ("work", "topic", "rank", "score"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "SortAggregate" not in plan
    found = {(r.work, r.topic): (r["rank"], str(r.score), r.conflicts) for r in merged.collect()}
    assert found == {
        ("w", "t"): (1, "0.5", []), ("w", "u"): (2, "None", []), ("x", "t"): (3, "0.25", ["rank"]),
        (None, "t"): (4, "1.0", []), ("y", "t"): (1, "nan", ["score"]), ("z", "t"): (None, "0.0", []),
    }


def shuffle_files(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in name}


def test_stored_steps_leave_no_shuffle_files(spark):
    rows = spark.range(2000).selectExpr("concat('k', lpad(id % 700, 3, '0')) AS nk").distinct()
    before = shuffle_files(spark)
    keyed = ordered_keys(rows, ("nk",), "key")
    table = stored(rows.withColumn("n", S.F.lit(1)), "names")
    assert shuffle_files(spark) <= before
    assert {r.nk: r.key for r in keyed.collect()} == {f"k{i:03d}": i + 1 for i in range(700)}
    assert table.count() == 700 and all(".zstd." in name for name in table.inputFiles())
    # the setting holds for these steps alone, and as it was before
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(setting) == "false"
    spark.conf.set(setting, "true")
    try:
        with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
            1 / 0  # noqa: B018
        assert spark.conf.get(setting) == "true"
    finally:
        spark.conf.unset(setting)
