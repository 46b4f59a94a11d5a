from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from samples import JOURNAL, cell, four_cells, institution, three_works, topic, work

from pubmart.functions.text import WHITE_SPACE, clean_text, trimmed
from pubmart.operators.checks import CheckFailed
from pubmart.plans.load import load_reconciled, open_reconciled
from pubmart.plans.reconcile import coverage_summary
from pubmart.sources import records
from pubmart.sources.records import read_panel, read_works, typed_works
from pubmart.sources.releases import NotPublished, current_version
from pubmart.sources.sinks import ChecksumMismatch
from pubmart.verification import build_registry
from pubmart.verification.raw_roles import raw_works, spread, typed_role_works


def core_works() -> list[dict]:
    return [
        work(
            1,
            topics=[topic(1, "Vision"), topic(2, "Language", None)],
            authorships=[
                {"countries": ["IT"], "institutions": [institution("IT")]},
                {"countries": ["IT", "US"], "institutions": [institution(None, "Nowhere")]},
            ],
        ),
        work(2, authorships=[{"countries": ["IT"], "institutions": []}], open_access={"is_oa": False}),
        work(
            3,
            None,
            topics=None,
            primary_topic=None,
            authorships=None,
            primary_location=None,
            open_access={"is_oa": None},
        ),
    ]


CORE_CELLS = [cell("IT", 2022, 59, 2.0), cell("US", 2022, None, None, None, None)]


@pytest.fixture
def load(spark, tmp_path, write_lines):
    def run(works, cells=CORE_CELLS, **options):
        return load_reconciled(
            spark,
            write_lines("works.jsonl", works),
            write_lines("panel.jsonl", cells),
            str(tmp_path / "reconciled"),
            **options,
        )

    return run


def test_core_counts(load):
    tables = load(core_works())
    assert {name: rows.count() for name, rows in tables.items()} == {
        "r_country": 2,
        "r_topic": 2,
        "r_institution": 2,
        "r_source": 1,
        "r_work": 3,
        "r_work_topic": 3,
        "r_work_country": 3,
        "r_work_institution": 2,
        "r_country_year_indicator": 2,
    }
    flags = {row.work_id[-2:]: row.is_open_access for row in tables["r_work"].collect()}
    assert flags == {"W1": True, "W2": False, "W3": None}
    ranks = [
        (row.topic_rank, row.topic_score)
        for row in tables["r_work_topic"].where("work_id like '%W1'").orderBy("topic_rank").collect()
    ]
    assert ranks == [(1, 0.9), (2, None)]
    nowhere = tables["r_institution"].where("country_code_iso2 is null").collect()
    assert [row.display_name for row in nowhere] == ["Nowhere Institute"]
    empty = tables["r_country_year_indicator"].where("country_code_iso2 = 'US'").first()
    assert empty.population is None and empty.rd_expenditure_pct_gdp is None


def test_copies_fill_each_other(load):
    bare = work(1, doi="10.1/x", title=None, primary_location={"source": {**JOURNAL, "issn_l": None}})
    row = load([work(1), bare])["r_work"].first()
    assert (row.doi, row.title) == ("10.1/x", "Work 1")


BROKEN_WORKS = [
    ({"publication_year": 2021}, "publication_date and publication_year differ"),
    ({"publication_date": "2022-02-30"}, "publication_date is not a date"),
    ({"topics": [topic(9, "Other")]}, "primary_topic is absent from topics"),
    ({"topics": None}, "primary_topic is absent from topics"),
    ({"topics": [None]}, "topics without id"),
    ({"topics": "none"}, "malformed JSON object"),
    ({"title": 5, "display_name": None}, "title is not text"),
    ({"title": "Another title"}, "title differs from display_name"),
    ({"id": "  "}, "id is missing"),
    ({"publication_year": 99999999999, "publication_date": None}, "publication_year is out of range"),
    ({"cited_by_count": -1}, "cited_by_count is negative"),
    ({"cited_by_count": 1.5}, "cited_by_count is not an integer"),
    ({"cited_by_count": True}, "cited_by_count is not an integer"),
    ({"open_access": {"is_oa": "yes"}}, "open_access.is_oa is not a flag"),
    ({"primary_location": {"source": {"id": None}}}, "source without id"),
    ({"authorships": [None]}, "authorships with null"),
    ({"authorships": [{"countries": ["it"]}]}, "author country code"),
    ({"authorships": [{"countries": [7]}]}, "author countries with wrong types"),
    ({"authorships": [{"institutions": [institution("ITA")]}]}, "institution id or country code"),
]
NO_OBJECTS = ["{not json", "[1, 2]", '[{"id": "x"}]', "5"]


def test_broken_records_are_named(spark, write_lines):
    records = [work(i, doi=f"case {i}", **change) for i, (change, _) in enumerate(BROKEN_WORKS)]
    works = read_works(spark, write_lines("works.jsonl", [work(99, doi="case 99"), *records, *NO_OBJECTS]))
    found = works.select("doi", "problems").collect()
    by_case = {row.doi: row.problems for row in found if row.doi}
    assert by_case["case 99"] == []
    for i, (_, expected) in enumerate(BROKEN_WORKS):
        assert expected in by_case[f"case {i}"], (i, by_case[f"case {i}"])
    assert [row.problems for row in found if not row.doi] == [["malformed JSON object"]] * len(NO_OBJECTS)


def test_load_names_the_broken_rules(load):
    with pytest.raises(CheckFailed, match=r"1 of 2 works records: title is not text \(1\)"):
        load([work(1), work(2, title=5, display_name=None)])


def test_blank_lines_are_skipped_and_order_is_kept(spark, write_lines):
    path = write_lines("works.jsonl", ["", work(1), "   "])
    row = read_works(spark, path).first()
    assert row.problems == [] and [t.topic_id[-2:] for t in row.topics] == ["T1"]


def test_conflicts_are_named(load):
    other = institution("IT")
    other["display_name"] = "Renamed"
    with pytest.raises(CheckFailed, match="conflicts in r_institution.*display_name"):
        load([work(1), work(2, authorships=[{"countries": [], "institutions": [other]}])])


def test_one_topic_at_two_ranks_is_a_conflict(load):
    vision = topic(1, "Vision")
    with pytest.raises(CheckFailed, match="conflicts in r_work_topic.*topic_rank"):
        load([work(1, topics=[vision, vision])])


def test_broken_panel_records(spark, write_lines):
    changes = {
        "country_code_iso2": "ita",
        "country_code_iso3": None,
        "year": None,
        "population": "many",
        "region_name": 3,
    }
    records = [{**cell("DE", 2022, 1), name: value} for name, value in changes.items()]
    rows = read_panel(spark, write_lines("panel.jsonl", records)).collect()
    assert [row.problems for row in rows] == [[name] for name in changes]


def test_numbers_are_kept_or_named(spark, write_lines):
    kept = {"internet_users_pct": 1e-14, "rd_expenditure_pct_gdp": 1.1234567890123456, "gdp_current_usd": 123456789012.25}
    lost = {"gdp_current_usd": 1e27, "internet_users_pct": 1e-19}
    records = [{**cell("DE", 2022, 1), **kept}, {**cell("DE", 2023, 1), **lost}, {**cell("DE", 2024, 1), "year": 99999999999}]
    records.append({**cell("DE", 2025, 1), "population": 1e19})
    first, *others = read_panel(spark, write_lines("panel.jsonl", records)).collect()
    assert first.problems == [] and {name: float(first[name]) for name in kept} == kept
    assert [row.problems for row in others] == [
        [f"{name} cannot be held exactly" for name in ("gdp_current_usd", "internet_users_pct")],
        ["year"],
        ["population is out of range"],
    ]


def test_panel_keys(load):
    with pytest.raises(CheckFailed, match="duplicate key on r_country_year_indicator"):
        load(core_works(), [*CORE_CELLS, cell("IT", 2022, 5)])
    with pytest.raises(CheckFailed, match="country_code_iso3"):
        load(core_works(), [*CORE_CELLS, {**cell("US", 2022, 5), "country_code_iso2": "UU"}])


def test_empty_inputs(load):
    with pytest.raises(CheckFailed, match="works input is empty"):
        load([""])


def test_panel_values_keep_their_type(spark, write_lines):
    path = write_lines("panel.jsonl", [cell("IT", 2022, 60_000_000, 2.5e12)])
    row = read_panel(spark, path).first()
    assert (row.population, float(row.gdp_current_usd)) == (60_000_000, 2.5e12)


def test_places_outside_the_panel(load):
    tables = load(three_works(), four_cells())
    added = tables["r_country"].where("not has_indicator_data").orderBy("country_code_iso2").collect()
    assert [(r.country_code_iso2, r.country_code_iso3, r.region_name) for r in added] == [
        ("RE", "REU", None),
        ("TW", "TWN", None),
    ]
    summary = coverage_summary(tables["r_country"]).first()
    assert tuple(summary) == (5, 3, ["RE", "TW"])
    with pytest.raises(CheckFailed, match="ZZ"):
        load([work(1, authorships=[{"countries": ["ZZ"]}])])


def test_failed_load_keeps_the_published_version(spark, tmp_path, load):
    root = str(tmp_path / "reconciled")
    with pytest.raises(NotPublished):
        open_reconciled(spark, root)
    load(core_works(), validate_only=True)
    assert current_version(spark, root) == 0
    load(core_works())
    with pytest.raises(CheckFailed):
        load([work(1, title=1)])
    assert current_version(spark, root) == 1
    assert open_reconciled(spark, root)["r_work"].count() == 3
    load([work(7)])
    assert open_reconciled(spark, root)["r_work"].first().work_id.endswith("W7")


def test_manifest_checksum(tmp_path, load, write_lines):
    path = write_lines("works.jsonl", core_works())
    manifest = tmp_path / "manifest.json"
    with open(path, "rb") as source:
        manifest.write_text(json.dumps({"sha256": hashlib.sha256(source.read()).hexdigest()}))
    load(core_works(), manifest_path=str(manifest))
    manifest.write_text(json.dumps({"sha256": "0" * 64}))
    with pytest.raises(ChecksumMismatch):
        load(core_works(), manifest_path=str(manifest))
    load(core_works(), manifest_path=str(tmp_path / "absent.json"))


def test_records_of_one_row_group_are_made_and_parsed_by_many_tasks(spark, tmp_path):
    orders = spark.range(1, 201).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "9000D AS o_totalprice",
        "timestamp'1997-03-04 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    raw = raw_works(spark, str(tmp_path))
    assert raw.select(F.spark_partition_id()).distinct().count() > 1
    assert raw.count() == 202 and raw.distinct().count() == 202  # orders 89 and 178 have two records
    assert spread(orders, 10).rdd.getNumPartitions() == 20
    found = typed_works(raw).select("work_id", F.size("problems").alias("n"))
    assert found.distinct().count() == 200 and found.where("n > 0").count() == 0


def test_reject_reasons_count_works_by_one_line_each(spark, tmp_path):
    orders = spark.createDataFrame([(89, 3), (178, 3), (267, 3), (1, 4)], "o_orderkey LONG, o_custkey LONG").selectExpr(
        "*", "'F' AS o_orderstatus", "9000D AS o_totalprice",
        "timestamp'1997-03-04 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert typed_role_works(spark, str(tmp_path)).count() == 7
    found = build_registry().queries["reject_reasons"](spark, str(tmp_path))
    assert sum(row.works for row in found.collect()) == 4


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ('{"id": "W1", "title" : 5, "display_name": "5"}', ["title is not text"]),
        ('{"id": "W1", "t\\u0069tle": 5, "display_name": "5"}', ["title is not text"]),
        ("{'id': 'W1', 'title': 5, 'display_name': '5'}", ["title is not text"]),
        ('{"id": "W1", "authorships": [{"countries": ["IT", null, 5]}]}', ["author country code", "author countries with wrong types"]),
        ('{"id": "W1", "authorships": [{"countries": ["IT" , "US"]}]}', []),
        ('{"id": "W1", "language": {"a": "x"}}', ["language is not text"]),
        ('{"id": "W1", "language":true}', ["language is not text"]),
        ('{"id": "W1", "language": null, "other": {"type": "\\\\\\"id\\\\\\": 5"}}', []),
        ('{"id": "\\u00a0 \\t"}', ["id is missing"]),
    ],
)
def test_wrong_types_are_found_however_the_line_is_written(spark, line, expected):
    lines = spark.createDataFrame([(line,)], "value STRING")
    assert typed_works(lines).first().problems == expected


def test_no_json_value_passes_for_a_text(spark):
    values = ["5", "0", "-0.5", "1.5e3", "NaN", "-INF", "+INF", "Infinity", "false", "[5]", '["a", {}]', '{"a": 1}', "9" * 50]
    work = '{"id": "W1", "topics": [{"id": "T1", "domain": {"id": %s}}], "primary_location": {"source": {"id": "S1", "type": %s}}}'
    lines = spark.createDataFrame([(work % (v, v),) for v in values], "value STRING").coalesce(1)
    found = [row.problems for row in typed_works(lines).collect()]
    assert found == [["topics with wrong types", "source with wrong types"]] * len(values)


def test_texts_are_judged_as_parsed_and_lines_are_not_searched(spark):
    """Keys and texts that only look like wrong values cost no second, strict parse: the line itself meets no pattern."""
    line = '{"id": "W1", "title": "007", "other": {"type": 5}, "primary_location": {"source": {"id": "S1", "issn_l": "00001234"}}}'
    typed = typed_works(spark.createDataFrame([(line,)], "value STRING"))
    assert typed.first().problems == []
    assert "RLIKE(value" not in typed._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    looks = "007|00001234|1996-04-03|1234-5678|0000-0001|topic 5|true story".split("|")
    texts = spark.createDataFrame([(t,) for t in looks], "t STRING")
    assert texts.where(records._looks_like_json(F.col("t"))).count() == 0


@pytest.mark.parametrize("text", ["", " ", "x", " x", "x ", " x y　", "\x7f", "\x7fx", "é", " é\x85", "!~", "~", "\x1f!"])
def test_trimming_of_plain_and_other_ends(spark, text):
    row = spark.createDataFrame([(text,)], "t STRING").select(trimmed(F.col("t")).alias("a"), clean_text(F.col("t")).alias("b")).first()
    assert row.a == text.strip(WHITE_SPACE) and row.b == (text.strip(WHITE_SPACE) or None)


def test_members_are_cleaned_text_by_text(spark):
    """Interpreted functions see single texts: none of them reads fields of topics or institutions."""
    line = json.dumps(
        {
            "id": "W1",
            "topics": [None, {"id": " T1 ", "subfield": {"id": " "}, "score": 0.5}],
            "primary_topic": {"id": "T1"},
            "authorships": [None, {"countries": None, "institutions": [None, {"id": "I1", "country_code": " "}]}],
        }
    )
    typed = typed_works(spark.createDataFrame([(line,)], "value STRING"))
    row = typed.first()
    assert [t.topic_id for t in row.topics] == [None, "T1"] and row.topics[1].score == 0.5
    assert row.topics[1].subfield_id is None
    assert [i.institution_id for i in row.institutions] == [None, "I1"]
    assert row.problems == ["topics without id", "authorships with null", "institution id or country code"]
    topics = typed.select("topics")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in topics and ".subfield.id" in topics
    assert "lambdafunction(named_struct" not in topics


def test_sample_lines_are_hashed_once(spark, tmp_path):
    orders = spark.range(1, 401).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "9000D AS o_totalprice",
        "timestamp'1997-03-04 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    drawn = build_registry().queries["sample_allocation"](spark, str(tmp_path))
    assert "sha2" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert [(row.year, row.allocation) for row in drawn.collect()] == [(1997, 500)]


def test_topic_bridge_is_built_on_staged_tables(spark, tmp_path):
    """Works and pairs are merged once and read as compressed tables; no row, rank or weight is lost."""
    spark.range(1, 401).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "9000D AS o_totalprice",
        "timestamp'1997-03-04 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS c_custkey, 1 AS c_nationkey FROM range(7)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    works = typed_role_works(spark, str(tmp_path))
    assert works.inputFiles() and all(".zstd." in name for name in works.inputFiles())
    bridge = build_registry().queries["build_bridge_publication_topic"](spark, str(tmp_path))
    assert {name.split("/")[-2].rsplit("-", 1)[0] for name in bridge.inputFiles()} == {"r_work", "r_work_topic"}
    plan = bridge._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "LeftAnti" not in plan
    works_by_text = sorted(range(1, 401), key=lambda k: f"W{k}")
    topics = sorted({k % 7 + i for k in range(1, 401) for i in range(k % 4)}, key=lambda t: f"T{t}")
    want = {
        (works_by_text.index(k) + 1, topics.index(k % 7 + i) + 1): (i + 1, 1 - i * 0.25, str(i == k % (k % 4)).lower(), round(1 / (k % 4), 6))
        for k in range(1, 401) for i in range(k % 4)
    }
    rows = bridge.collect()
    found = {(r[0], r[1]): tuple(r)[2:] for r in rows}
    assert len(rows) == len(want) and found == want
