"""Entities of records through a pluggable extractor, and token strings of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import with_position

ENTITY = "struct<text: string, label: string, start: int, end: int, confidence: double>"
RESULT = f"entities array<{ENTITY}>, total_entities int, error string"


@dataclass
class NerConfig:
    """What a run may set; batch_size sets how many records an extractor gets at a time."""

    entity_types: tuple[str, ...] | None = None
    min_confidence: float = 0.0
    batch_size: int = 100
    model_type: str = "rules"
    backoff: str | None = None
    options: dict = field(default_factory=dict)


#: Words that name kinds of organisations, and countries and cities of the rule extractor.
ORG_WORDS = ("University", "Institute", "College", "Laboratory", "Laboratories", "Lab", "Labs", "Center", "Centre", "Department", "School", "Faculty", "Hospital", "Research", "Inc", "Corp", "Ltd", "GmbH", "Foundation", "Academy", "Association", "Agency", "Bank", "Company", "Ministry", "Museum", "Society", "Trust")
PLACES = ("USA", "Germany", "France", "Spain", "Italy", "Canada", "China", "Japan", "India", "Brazil", "London", "Paris", "Berlin", "Madrid", "Rome", "Montreal", "Zurich", "Boston", "San Jose", "New York", "Argentina", "Australia", "Austria", "Belgium", "Chile", "Denmark", "Egypt", "Finland", "Greece", "Ireland", "Israel", "Mexico", "Netherlands", "Norway", "Poland", "Portugal", "Russia", "Singapore", "South Africa", "Sweden", "Switzerland", "Turkey", "UK", "United Kingdom", "United States", "Amsterdam", "Beijing", "Chicago", "Dublin", "Lisbon", "Moscow", "Oslo", "San Francisco", "Seoul", "Stockholm", "Tokyo", "Toronto", "Vienna", "Warsaw")
_CAP = r"[A-Z][A-Za-z&.-]*"
_ORG = re.compile(rf"(?:{_CAP} )*(?:{'|'.join(ORG_WORDS)})\b(?: of(?: {_CAP})+)?")
_GPE = re.compile(rf"\b(?:{'|'.join(PLACES)})\b")
_ACRONYM = re.compile(r"\b[A-Z]{2,}\b", re.ASCII)


def rule_extractor() -> Callable[[str], list[tuple]]:
    """Organisations by key words, places by a gazetteer; no confidence."""

    def extract(text: str) -> list[tuple]:
        found = [(m[0], "ORG", m.start(), m.end(), None) for m in _ORG.finditer(text)]
        taken = [(a, b) for _, _, a, b, _ in found]
        found += [(m[0], "GPE", m.start(), m.end(), None) for m in _GPE.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)]
        return sorted(found, key=lambda e: e[2])

    return extract


def acronym_extractor() -> Callable[[str], list[tuple]]:
    """Runs of capitals as organisations, with a confidence: a plain second choice."""
    return lambda text: [(m[0], "ORG", m.start(), m.end(), 0.5) for m in _ACRONYM.finditer(text)]


def spacy_extractor(model_name: str = "en_core_web_sm") -> Callable[[str], list[tuple]]:
    try:
        import spacy

        nlp = spacy.load(model_name)
    except (ImportError, OSError) as e:
        raise OSError(f"model {model_name!r} can't be loaded; install spacy and the model first") from e
    return lambda text: [(x.text, x.label_, x.start_char, x.end_char, None) for x in nlp(text).ents]


def transformer_extractor(model_name: str = "dslim/bert-base-NER") -> Callable[[str], list[tuple]]:
    try:
        from transformers import pipeline

        run = pipeline("ner", model=model_name, aggregation_strategy="simple", device=-1)
    except (ImportError, OSError) as e:
        raise OSError(f"model {model_name!r} can't be loaded; install transformers and the model first") from e
    return lambda text: [(x["word"], x.get("entity_group") or x.get("entity"), int(x["start"]), int(x["end"]), float(x["score"])) for x in run(text)]


EXTRACTORS = {"rules": rule_extractor, "acronyms": acronym_extractor, "spacy": spacy_extractor, "transformer": transformer_extractor}


def extract_entities(records: DataFrame, text_col: str = "affil1", config: NerConfig | None = None) -> DataFrame:
    """The records with entities, total_entities and error.

    Blank texts have no entities. The second extractor runs only where the
    first found none of the wanted types; models load once per worker and only
    when needed. A model that can't be loaded fails the call, before any record
    is read; a record whose extraction fails has no entities and its error.
    """
    config = config or NerConfig()
    for kind in (config.model_type, config.backoff):
        if kind is not None and kind not in EXTRACTORS:
            raise ValueError(f"unknown model type {kind!r}; choose from {', '.join(EXTRACTORS)}")
    if config.batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    for kind in (config.model_type, config.backoff):
        if kind is not None:
            EXTRACTORS[kind](**config.options.get(kind, {}))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", " + RESULT

    def wanted(found: list[tuple]) -> list[tuple]:
        return [e for e in found if (config.entity_types is None or e[1] in config.entity_types) and (e[4] is None or e[4] >= config.min_confidence)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Callable] = {}

        def load(kind: str) -> None:
            if kind not in loaded:
                loaded[kind] = EXTRACTORS[kind](**config.options.get(kind, {}))

        def by(kind: str, text: str) -> list[tuple]:
            return wanted(loaded[kind](text))

        def one(text) -> tuple[list[dict], str | None]:
            text = "" if text is None else str(text)
            if not text.strip():
                return [], None
            load(config.model_type)
            try:
                found = by(config.model_type, text)
                if not found and config.backoff:
                    load(config.backoff)
                    found = by(config.backoff, text)
            except Exception as e:  # the record keeps its error, the others go on
                return [], f"{type(e).__name__}: {e}"
            return [dict(zip(("text", "label", "start", "end", "confidence"), e, strict=True)) for e in found], None

        for batch in (b.iloc[i : i + config.batch_size] for b in batches for i in range(0, len(b), config.batch_size)):
            got = [one(t) for t in batch[text_col]]
            yield batch.assign(entities=[g[0] for g in got], total_entities=pd.Series([len(g[0]) for g in got], index=batch.index, dtype="int32"), error=[g[1] for g in got])

    return records.mapInPandas(run, schema)


def _clean(e: Column) -> Column:
    return F.regexp_replace(F.trim(e), r"[;:,]+$", "")


def _distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """First of the items of each key, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def tokens_labeled(entities: Column) -> Column:
    """text<label>; text<label>: cleaned, without blanks, the first of equal texts (in any case) and labels."""
    items = F.filter(F.transform(entities, lambda e: F.struct(_clean(e["text"]).alias("t"), e["label"].alias("l"))), lambda x: x["t"] != "")
    once = _distinct_by(items, lambda x: F.concat_ws("\x01", F.lower(x["t"]), x["l"]))
    return F.array_join(F.transform(once, lambda x: F.concat(x["t"], F.lit("<"), x["l"], F.lit(">"))), "; ")


def tokens_plain(entities: Column) -> Column:
    """text; text: cleaned, without blanks, the first of equal texts in any case."""
    items = F.filter(F.transform(entities, lambda e: _clean(e["text"])), lambda t: t != "")
    return F.array_join(_distinct_by(items, F.lower), "; ")


def token_table(extracted: DataFrame, id_col: str = "id1") -> DataFrame:
    """(id, affil_tokens_labeled, affil_tokens, total_entities)."""
    return extracted.select(id_col, tokens_labeled(F.col("entities")).alias("affil_tokens_labeled"), tokens_plain(F.col("entities")).alias("affil_tokens"), "total_entities")


def merge_tokens(records: DataFrame, tokens: DataFrame, id_col: str = "id1", order: tuple[str, str] | None = None) -> DataFrame:
    """The records with their token strings; null where a record has none.

    By id if both have it; else by position: the first record gets the first
    row of tokens, in the orders of the two given columns.
    """
    if id_col in records.columns and id_col in tokens.columns:
        return records.join(tokens, id_col, "left")
    if order is None:
        raise ValueError(f"{id_col} is not in both tables: name a column of each to count by")
    a, b = with_position(records, order[0], name="_at"), with_position(tokens, order[1], name="_at")
    return a.join(b, "_at", "left").drop("_at")
