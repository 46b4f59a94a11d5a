"""JSON Lines scans: strict parsing, field checks and typed records.

The typed frames carry a ``problems`` column. Write them as a table (or checkpoint them) before
filtering or exploding: a filter placed directly on them is pushed below the projection, and
every record is then parsed once per use instead of once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmart.functions import typed as X
from pubmart.functions.text import clean_text, is_country_code, trimmed
from pubmart.schemas import MEASURES, PANEL_RECORD, WORK_RECORD


PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
MALFORMED = "malformed JSON object"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with the file they came from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.where(trimmed(F.col("value")) != "")


def parsed(lines: DataFrame, record: str) -> DataFrame:
    """One ``record`` struct per line; ``malformed`` marks bad JSON and non-objects."""
    rows = lines.withColumn("record", F.from_json("value", f"{record}, _corrupt STRING", PERMISSIVE))
    is_object = F.ltrim("value").startswith("{")
    bad = ~is_object | F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    return rows.withColumn("malformed", F.coalesce(bad, F.lit(True)))


# ---- works ---------------------------------------------------------------------------
#
# Works are parsed into plain types, which is fast but would turn a number in a text field into
# text. Such a text is written as the JSON value was: a number, a flag, an object or an array. Only a
# record with a text of that look is parsed again with VARIANT leaves, to name the wrong fields exactly. The
# look may suspect too much (a title of digits), never too little.

_STRICT_WORK = re.sub(r"\b(STRING|BIGINT|DOUBLE|BOOLEAN)\b", "VARIANT", WORK_RECORD)
# quotes are written around numbers that are none; no number begins with 0 and a digit, or goes on like a date
_NUMBER_LOOK = r'\A(?:"|[-+]?(?:0|[1-9]\d*+|\.\d)(?![\d-])|[-+]INF)'
_ONE_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+){0,99}+"'
# an array of texts in place of a text is let through, as before
_TEXTS = rf"\A\[\s*+(?:(?:{_ONE_TEXT}|null)\s*+(?:,\s*+|(?=\])))*+\]"
_WORD_LOOKS = ("true", "false", "NaN", "INF", "Infinity")
_LEVELS = ("subfield", "field", "domain")


_TOPIC_TEXTS = ("topic_id", "topic_name", *[f"{level}_{part}" for level in _LEVELS for part in ("id", "name")])


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _entries(values: Column) -> Column:
    return F.coalesce(values, F.array())


def _topic(t: Column) -> list[Column]:
    parts = [clean_text(t["id"]).alias("topic_id"), clean_text(t["display_name"]).alias("topic_name")]
    for level in _LEVELS:
        parts.append(clean_text(t[level]["id"]).alias(f"{level}_id"))
        parts.append(clean_text(t[level]["display_name"]).alias(f"{level}_name"))
    return parts


# A function of an array's structs is interpreted, and each use of a field reads the struct again. Fields
# taken from all structs at once are compiled; only the texts, one by one, meet the interpreted cleaning.


def _all_clean(texts: Column) -> Column:
    return F.transform(texts, clean_text)


def _listed_topics(topics: Column) -> dict[str, Column]:
    """The cleaned texts of all topics, an array for each field of ``_topic``."""
    found = {"topic_id": topics["id"], "topic_name": topics["display_name"]}
    for level in _LEVELS:
        found[f"{level}_id"] = topics[level]["id"]
        found[f"{level}_name"] = topics[level]["display_name"]
    return {name: _all_clean(texts) for name, texts in found.items()}


def _joined(lists: Column) -> Column:
    """The entries of all lists; missing lists have none."""
    return F.flatten(F.transform(_entries(lists), _entries))


_INSTITUTION = {
    "institution_id": "id", "display_name": "display_name", "institution_type": "type", "country_code_iso2": "country_code"
}


def _with_lists(works: DataFrame) -> DataFrame:
    """Columns of arrays, which the typed fields and the rules share."""
    authors = F.col("record.authorships")
    works = works.withColumns(
        {"_countries": _joined(authors["countries"]), "_institutions": _joined(authors["institutions"])}
    )
    topics = {f"_topic_{k}": v for k, v in _listed_topics(F.col("record.topics")).items()}
    members = {f"_of_{k}": _all_clean(F.col("_institutions")[v]) for k, v in _INSTITUTION.items()}
    return works.withColumns({**topics, **members})


def _zipped(arrays: dict[str, Column]) -> Column:
    """Arrays of equal length as one array of structs."""
    return F.arrays_zip(*[values.alias(name) for name, values in arrays.items()])


def _day(value: Column) -> Column:
    return F.try_to_date(clean_text(value), "yyyy-MM-dd")


def _bad_code(code: Column) -> Column:
    return ~F.coalesce(is_country_code(trimmed(code), 2), F.lit(False))


def work_value_rules(r: Column) -> dict[str, Column]:
    """Rules on the values of a parsed work with its lists, by name; true when the record breaks one."""
    primary, source = r["primary_topic"], r["primary_location"]["source"]
    day, date_text = _day(r["publication_date"]), clean_text(r["publication_date"])
    well_dated = date_text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & day.isNotNull()
    topic_ids, primary_id = F.col("_topic_topic_id"), clean_text(primary["id"])
    related = F.when(
        primary_id.isNotNull(), F.coalesce(F.array_contains(topic_ids, primary_id), F.lit(False))
    ).otherwise(_any(r["topics"], lambda t: trimmed(t["id"]) == trimmed(primary["id"])))

    def wrong_code(code: Column) -> Column:
        return code.isNotNull() & (code != "") & _bad_code(code)

    return {
        "id is missing": clean_text(r["id"]).isNull(),
        "title differs from display_name": clean_text(r["title"]) != clean_text(r["display_name"]),
        "publication_year is out of range": r["publication_year"].isNotNull()
        & r["publication_year"].try_cast("int").isNull(),
        "cited_by_count is negative": r["cited_by_count"] < 0,
        "publication_date is not a date": date_text.isNotNull() & ~well_dated,
        "publication_date and publication_year differ": F.year(day) != r["publication_year"],
        "topics without id": _any(topic_ids, lambda t: t.isNull()),
        "primary_topic without id": primary.isNotNull() & primary_id.isNull(),
        "primary_topic is absent from topics": primary.isNotNull() & ~related,
        "source without id": source.isNotNull() & clean_text(source["id"]).isNull(),
        "authorships with null": _any(r["authorships"], lambda a: a.isNull()),
        "author country code": _any(F.col("_countries"), lambda c: c.isNull() | _bad_code(c)),
        "institution id or country code": _any(F.col("_of_institution_id"), lambda i: i.isNull())
        | _any(F.col("_institutions")["country_code"], wrong_code),
    }


def work_type_rules(r: Column) -> dict[str, Column]:
    """Rules on the JSON types of a strictly parsed work."""

    def bad_topic(t: Column) -> Column:
        names = [t[level][part] for level in _LEVELS for part in ("id", "display_name")]
        texts = [X.not_text(value) for value in (t["id"], t["display_name"], *names)]
        return reduce(lambda a, b: a | b, texts) | X.not_number(t["score"])

    def bad_named(entity: Column, *more: str) -> Column:
        texts = [X.not_text(entity[part]) for part in ("id", "display_name", "type", *more)]
        return reduce(lambda a, b: a | b, texts)

    texts = ("id", "doi", "title", "display_name", "publication_date", "type", "language")
    rules = {f"{name} is not text": X.not_text(r[name]) for name in texts}
    return {
        **rules,
        "publication_year is not an integer": X.not_integer(r["publication_year"]),
        "cited_by_count is not an integer": X.not_integer(r["cited_by_count"]),
        "is_retracted is not a flag": X.not_flag(r["is_retracted"]),
        "open_access.is_oa is not a flag": X.not_flag(r["open_access"]["is_oa"]),
        "topics with wrong types": _any(r["topics"], bad_topic),
        "primary_topic with wrong types": bad_topic(r["primary_topic"]),
        "source with wrong types": bad_named(r["primary_location"]["source"], "issn_l"),
        "author countries with wrong types": _any(
            r["authorships"], lambda a: _any(a["countries"], X.not_text)
        ),
        "institutions with wrong types": _any(
            r["authorships"],
            lambda a: _any(a["institutions"], lambda i: bad_named(i, "country_code")),
        ),
    }


def _looks_like_json(text: Column) -> Column:
    """A parsed text may be a JSON value that was no text. Nearly all texts need no search."""
    return (
        ((text < ":") & text.rlike(_NUMBER_LOOK))
        | text.startswith("{")
        | (text.startswith("[") & ~text.rlike(_TEXTS))
        | text.isin(*_WORD_LOOKS)
    )


def _lists() -> Column:
    """All texts of a record's lists."""
    names = [f"_topic_{name}" for name in _TOPIC_TEXTS] + [f"_of_{name}" for name in _INSTITUTION]
    return F.concat(*[_entries(F.col(name)) for name in names], _entries(F.col("_countries")))


def _single_texts(r: Column) -> list[Column]:
    """A record's texts outside of lists."""
    primary, source = r["primary_topic"], r["primary_location"]["source"]
    texts = [r[name] for name in ("id", "doi", "title", "display_name", "publication_date", "type", "language")]
    texts += [entity[part] for entity in (primary, *[primary[level] for level in _LEVELS]) for part in ("id", "display_name")]
    return texts + [source[part] for part in ("id", "display_name", "type", "issn_l")]


def _work_problems() -> Column:
    strict = F.from_json("value", f"{_STRICT_WORK}, _corrupt STRING", PERMISSIVE)
    wrong_types = F.when(
        strict.isNull() | strict["_corrupt"].isNotNull() | ~F.ltrim("value").startswith("{"),
        F.array(F.lit(MALFORMED)),
    ).otherwise(X.problems(work_type_rules(strict)))
    looks = [_any(_lists(), _looks_like_json), *[_looks_like_json(text) for text in _single_texts(F.col("record"))]]
    suspect = reduce(lambda a, b: a | b, [F.coalesce(found, F.lit(False)) for found in looks], F.col("malformed"))
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(F.col("malformed"), none).otherwise(X.problems(work_value_rules(F.col("record")))),
        F.when(suspect, wrong_types).otherwise(none),
    )


def typed_works(lines: DataFrame, *more: str) -> DataFrame:
    """Typed columns and broken rules of JSON works, and ``more`` columns of the lines. Topics
    keep their order; authors are flattened."""
    works = _with_lists(parsed(lines, WORK_RECORD))
    r = F.col("record")
    source = r["primary_location"]["source"]
    topics = {name: F.col(f"_topic_{name}") for name in _listed_topics(r["topics"])}
    members = {name: F.col(f"_of_{name}") for name in _INSTITUTION}
    return works.select(
        clean_text(r["id"]).alias("work_id"),
        clean_text(r["doi"]).alias("doi"),
        F.coalesce(clean_text(r["title"]), clean_text(r["display_name"])).alias("title"),
        _day(r["publication_date"]).alias("publication_date"),
        r["publication_year"].try_cast("int").alias("publication_year"),
        clean_text(r["type"]).alias("work_type"),
        clean_text(r["language"]).alias("language"),
        r["cited_by_count"].alias("cited_by_count"),
        r["is_retracted"].alias("is_retracted"),
        r["open_access"]["is_oa"].alias("is_open_access"),
        F.when(r["primary_topic"].isNotNull(), F.struct(*_topic(r["primary_topic"]))).alias("primary_topic"),
        _zipped({**topics, "score": r["topics"]["score"]}).alias("topics"),
        F.when(
            source.isNotNull(),
            F.struct(
                clean_text(source["id"]).alias("source_id"),
                clean_text(source["display_name"]).alias("display_name"),
                clean_text(source["type"]).alias("source_type"),
                clean_text(source["issn_l"]).alias("issn_l"),
            ),
        ).alias("source"),
        _all_clean(F.col("_countries")).alias("author_countries"),
        _zipped(members).alias("institutions"),
        _work_problems().alias("problems"),
        *more,
    )


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return typed_works(json_lines(spark, path))


# ---- country-year panel --------------------------------------------------------------

_PANEL_TEXTS = ("country_name", "region_id", "region_name", "income_level_id", "income_level_name")


def _people(r: Column) -> Column:
    return F.round(X.decimal(r["population"]), 0).try_cast("bigint")


def panel_rules(r: Column) -> dict[str, Column]:
    rules = {
        "country_code_iso2": X.not_code(r["country_code_iso2"], 2),
        "country_code_iso3": X.not_code(r["country_code_iso3"], 3),
        "year": X.not_integer(r["year"]) | X.integer(r["year"]).try_cast("int").isNull(),
        "population is out of range": _people(r).isNull() & X.decimal(r["population"]).isNotNull(),
    }
    rules.update({name: X.not_text(r[name]) for name in _PANEL_TEXTS})
    rules.update({name: X.not_number(r[name]) for name in MEASURES})
    rules.update({f"{name} cannot be held exactly": X.inexact(r[name]) for name in MEASURES})
    return rules


def typed_panel(lines: DataFrame) -> DataFrame:
    """Typed columns and broken rules of JSON panel records."""
    r = F.col("record")
    measures = {name: X.decimal(r[name]) for name in MEASURES}
    measures["population"] = _people(r)
    found = F.when(F.col("malformed"), F.array(F.lit(MALFORMED))).otherwise(X.problems(panel_rules(r)))
    return parsed(lines, PANEL_RECORD).select(
        X.text(r["country_code_iso2"]).alias("country_code_iso2"),
        X.text(r["country_code_iso3"]).alias("country_code_iso3"),
        *[X.text(r[name]).alias(name) for name in _PANEL_TEXTS],
        X.integer(r["year"]).try_cast("int").alias("year"),
        *[value.alias(name) for name, value in measures.items()],
        found.alias("problems"),
    )


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return typed_panel(json_lines(spark, path))
