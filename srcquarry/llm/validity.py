"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar_cpp, grammar_go, grammar_python

GRAMMARS = {"python": grammar_python.valid, "go": grammar_go.valid, "cpp": grammar_cpp.valid}

# Token sequences that tell the languages apart. They are counted as plain text, which is much
# cheaper than a parse and enough for an order of trial.
_EVIDENCE = {
    "python": ("def ", "class ", "import ", "self", "None", "elif ", "except", ":\n", "):\n", "    return "),
    "go": ("func ", "package ", ":= ", "nil", "\n\t", "map[", "defer ", "chan ", "import (", "err "),
    "cpp": ("#include", "#define", "#pragma", "::", ";\n", "nullptr", "template", "std", "->", ");\n"),
}


def ranked(text: str) -> list[str]:
    """The grammars, most likely first by the tokens that tell the languages apart."""
    found = {lang: sum(map(text.count, marks)) for lang, marks in _EVIDENCE.items()}
    return sorted(found, key=lambda lang: (-found[lang], lang))


def accepting(text: str) -> list[str]:
    """The languages whose grammar accepts a text, most likely first; every grammar is tried."""
    return [lang for lang in ranked(text) if GRAMMARS[lang](text)]


def valid_in(text: str | None, language: str | None) -> bool | None:
    """Whether a text is valid in its language. Markdown and blank texts always are; nothing can be said for null texts and unknown languages."""
    if text is None or language != "markdown" and language not in GRAMMARS:
        return None
    return language == "markdown" or not text.strip() or GRAMMARS[language](text)


def judge(text: str | None, language: str | None) -> tuple[bool | None, str | None]:
    """Whether a text is valid in its language, and the language it parses as: its own if it is valid there, else the likeliest that accepts it."""
    valid = valid_in(text, language)
    return valid, language if valid else next(iter(accepting(text)), None) if valid is False else None


def judge_files(files: DataFrame, *, key: list[str], text: str, language: str) -> DataFrame:
    """One row per row of ``files``: key, ``valid``, ``accepted_by``, ``parses_as``, ``verdict``.

    Every text is parsed by every grammar. ``accepted_by`` has all languages that accept it, most likely first
    (none for blank texts); ``parses_as`` is the declared one if the text is valid there, else the first of them. ``verdict`` is 'valid', 'wrong_extension' (another grammar accepts the text, the declared one
    does not; of Markdown, which is valid all the same, any grammar does), 'corrupt' (none does) or null (nothing
    can be said: null texts, null and unknown languages). Repeated rows are judged each; an empty table gives
    none; whole texts are parsed, however long. Only the named columns are read.
    """
    src = files.select(*[F.col(k) for k in key], F.col(language).alias("__lang"), F.col(text).alias("__text"))
    n = len(key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, accepted = [], []
            for lang, t in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                blank = t is None or not t.strip()
                accepted.append(None if t is None else [] if blank else accepting(t))
                valid.append(valid_in(t, lang) if blank or lang not in GRAMMARS else lang in accepted[-1])
            columns = [batch.column(k) for k in range(n)]
            columns += [batch.column(n), pa.array(valid, pa.bool_()), pa.array(accepted, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "__lang", "valid", "accepted_by"])

    out = src.mapInArrow(run, f"{fields}, __lang string, valid boolean, accepted_by array<string>")
    foreign = F.size("accepted_by") > 0
    verdict = (
        F.when((F.col("__lang") == "markdown") & F.col("valid"), F.when(foreign, "wrong_extension").otherwise("valid"))
        .when(F.col("valid"), "valid")
        .when(~F.col("valid") & foreign, "wrong_extension")
        .when(~F.col("valid"), "corrupt")
    )
    likeliest = F.get("accepted_by", F.lit(0))
    parses_as = F.when(F.col("valid") & (F.col("__lang") != "markdown"), F.col("__lang")).otherwise(F.coalesce(likeliest, F.when(F.col("valid"), F.col("__lang"))))
    return out.select(*key, "valid", "accepted_by", parses_as.alias("parses_as"), verdict.alias("verdict"))


def invalid_rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """Files, invalid files and their rate per group; files without a verdict do not count. Narrow rows, partly aggregated before the shuffle."""
    return (
        judged.where(F.col("valid").isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("files"),
            F.count_if(~F.col("valid")).alias("invalid"),
            F.count_if(F.col("verdict") == "wrong_extension").alias("wrong_extension"),
            F.count_if(F.col("verdict") == "corrupt").alias("corrupt"),
        )
        .withColumn("invalid_rate", F.col("invalid") / F.col("files"))
    )
