"""Small hand-made records in the two raw shapes."""

from __future__ import annotations

BASE = "https://ids.example/"


def named(kind: str, number, name: str) -> dict:
    return {"id": f"{BASE}{kind}{number}", "display_name": name}


def topic(number: int, name: str, score: float | None = 0.9) -> dict:
    return {
        **named("T", number, name),
        "score": score,
        "subfield": named("subfields/", 1702, "Learning"),
        "field": named("fields/", 17, "Computing"),
        "domain": named("domains/", 3, "Physical"),
    }


def institution(code: str | None, name: str = "", kind: str = "education") -> dict:
    return {
        "id": f"{BASE}I-{name or code}",
        "display_name": f"{name or code} Institute",
        "type": kind,
        "country_code": code,
    }


JOURNAL = {**named("S", 1, "Journal"), "type": "journal", "issn_l": "1234-5678"}


def work(number: int, day: str | None = "2022-04-05", **changes) -> dict:
    first = topic(1, "Vision")
    record = {
        "id": f"{BASE}W{number}",
        "doi": None,
        "title": f"Work {number}",
        "display_name": f"Work {number}",
        "publication_date": day,
        "publication_year": int(day[:4]) if day else None,
        "type": "article",
        "language": "en",
        "cited_by_count": 3,
        "is_retracted": False,
        "primary_topic": first,
        "topics": [first],
        "authorships": [{"countries": ["IT"], "institutions": [institution("IT")]}],
        "primary_location": {"source": JOURNAL},
        "open_access": {"is_oa": True},
    }
    return {**record, **changes}


PLACES = {
    "IT": ("ITA", "Italy", "Europe & Central Asia"),
    "DE": ("DEU", "Germany", "Europe & Central Asia"),
    "US": ("USA", "United States", "North America"),
}


def cell(code: str, year: int, population=None, gdp=None, internet=80.0, spending=2.0) -> dict:
    iso3, name, region = PLACES[code]
    return {
        "country_code_iso2": code,
        "country_code_iso3": iso3,
        "country_name": name,
        "region_id": region[:3].upper(),
        "region_name": region,
        "income_level_id": "HIC",
        "income_level_name": "High income",
        "year": year,
        "population": population,
        "gdp_current_usd": gdp,
        "gdp_per_capita_current_usd": gdp / population if gdp and population else None,
        "internet_users_pct": internet,
        "rd_expenditure_pct_gdp": spending,
    }


def three_works() -> list[dict]:
    """Two topics with the second one primary; places outside the panel; no source; unknown
    open access."""
    vision, language = topic(1, "Vision", 0.95), topic(2, "Language", 0.75)
    return [
        work(
            1,
            "2022-04-05",
            cited_by_count=10,
            topics=[vision, language],
            primary_topic=language,
            authorships=[
                {"countries": ["IT", "TW"], "institutions": [institution("IT"), institution("TW")]}
            ],
        ),
        work(
            2,
            "2022-10-01",
            type="review",
            cited_by_count=4,
            authorships=[{"countries": ["RE"], "institutions": [institution("RE")]}],
            primary_location=None,
            open_access={"is_oa": False},
        ),
        work(
            3,
            "2023-01-15",
            type="preprint",
            cited_by_count=2,
            topics=[language],
            primary_topic=language,
            authorships=[{"countries": ["US", "DE"], "institutions": [institution("US")]}],
            open_access=None,
        ),
    ]


def four_cells() -> list[dict]:
    return [
        cell("IT", 2022, 60_000_000, 2.0e12),
        cell("IT", 2023, 59_000_000, 2.1e12, internet=None),
        cell("US", 2023, 335_000_000, 2.7e13),
        cell("DE", 2023, 84_000_000, 4.5e12),
    ]
