"""Quality rules by tokeniser fertility, with rejection bands per language or script.

A public vocabulary with byte fallback measures, for each whole text, characters
per token, the share of fallback tokens and the token entropy (as a share of the
most that so many tokens could have). The corpus itself sets the bands: for each
language and size class (powers of two of the token count) the median and the
median absolute deviation over all documents. A document outside ``width``
deviations in any measure is rejected. Values are rounded to a grid before the
medians are taken, so that the exact medians need a bounded table only.

A language is a code of two or three small letters (so there are at most 18,252);
anything else, null too, is replaced by the text's main script. A class with fewer
than ``least`` documents borrows the band of its language over all sizes, and
rejects nothing where that has too few as well.

Defined cases: a null or empty text has no words: every count is 0, base_failed
is true and kept false. A null ``doc_id`` stays null. Repeated rows are measured
and counted once each. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Words, cut, grams, slices
from skein.llm.vocab import pieces, vocabulary_path

MEASURES = {"chars_per_token": 0.01, "fallback_share": 0.002, "token_entropy": 0.005}  # each with its least deviation
GRID = 1000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: First code points of ranges and the script each begins (fixed values).
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))


def script_of(text: str) -> str:
    """The script of most of a text's letters; ``none`` without letters."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    points = points[(points > 127) | ((points | 32) - 97 < 26)]
    if not len(points):
        return "none"
    names = sorted({n for _, n in SCRIPTS})
    which = np.array([names.index(n) for _, n in SCRIPTS])[np.searchsorted([s for s, _ in SCRIPTS], points, side="right") - 1]
    return names[int(np.bincount(which).argmax())]


def _repeated(h: np.ndarray, n: int = 3) -> int:
    """Words that lie in an ``n``-word window found twice or more, its first finding included."""
    keys = grams(h, n)
    if len(keys) < 2:
        return 0
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    covered = np.zeros(len(h), dtype=bool)
    for k in range(n):
        covered[at + k] = True
    return int(covered.sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts, the three measures, language key and size class of every whole text."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    code = F.when(lang.rlike("^[a-z]{2,3}$"), lang)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), code.alias("lang_key"))
    schema = "doc_id long, lang_key string, size_class int, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{m} double" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fallback = pieces(path)
        for batch in slices(batches):
            column = batch.column("text")
            words = Words(column, lower=False)
            at, ptr = words.offsets, words.ptr
            head = (words.data & 0xC0) != 0x80
            space = (words.data == 32) | ((words.data >= 9) & (words.data <= 13))
            upto = np.concatenate([[0], np.cumsum(head & ~space)])
            symbols = np.concatenate([[0], np.cumsum(SYMBOL[words.data])])
            texts = column.to_pylist()
            raw = words.data.tobytes()
            out = {c: np.zeros(len(texts), dtype=np.int64) for c in COUNTS} | {m: np.zeros(len(texts)) for m in MEASURES}
            out["n_words"] = np.diff(ptr)
            out["word_chars"] = upto[at[1:]] - upto[at[:-1]]
            out["n_symbols"] = symbols[at[1:]] - symbols[at[:-1]]
            keys = batch.column("lang_key").to_pylist()
            for i, (text, ids) in enumerate(zip(texts, model.encode(texts, num_threads=1))):
                out["n_dup_lines"][i] = _dup_lines(raw[at[i] : at[i + 1]])
                out["n_repeat_words"][i] = _repeated(words.hash[ptr[i] : ptr[i + 1]])
                keys[i] = keys[i] or script_of(text)
                n = out["n_tokens"][i] = len(ids)
                if not n:
                    continue
                ids = np.array(ids, dtype=np.int32)
                count = np.bincount(ids, minlength=len(fallback))
                out["fallback_share"][i] = count[fallback].sum() / n
                share = count[count > 0] / n
                out["token_entropy"][i] = -(share * np.log2(share)).sum() / np.log2(max(2, n))
                out["chars_per_token"][i] = out["word_chars"][i] / n
            size = np.floor(np.log2(np.maximum(out["n_tokens"], 16))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(size), *(pa.array(x) for x in out.values())], ["doc_id", "lang_key", "size_class", *out])

    return rows.mapInArrow(run, schema)


def _middle(rows: DataFrame, by: list[str], values: dict[str, F.Column]) -> DataFrame:
    """Exact medians of ``values`` on the grid, and the number of rows, by ``by``."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(F.round(v * GRID).cast("long"), F.lit(0.5)).alias(m) for m, v in values.items()))


def _bands(measured: DataFrame, by: list[str]) -> DataFrame:
    """Middle and deviation of each measure; one row per language and size class, so bounded."""
    middle = _middle(measured, by, {m: F.col(m) for m in MEASURES}).select(*by, "n", *((F.col(m) / GRID).alias(f"{m}_mid") for m in MEASURES))
    away = _middle(measured.join(F.broadcast(middle.drop("n")), by), by, {m: F.abs(F.col(m) - F.col(f"{m}_mid")) for m in MEASURES})
    return middle.join(F.broadcast(away.select(*by, *(F.greatest(F.col(m) / GRID * 1.4826, F.lit(least)).alias(f"{m}_dev") for m, least in MEASURES.items()))), by)


def judge(docs: DataFrame, width: float = 5.0, least: int = 20, path: str | None = None) -> DataFrame:
    """Every document's counts and measures, ``base_failed`` and ``kept``."""
    measured = cut(measure(docs, path), "fertility")
    fine = _bands(measured, ["lang_key", "size_class"]).filter(F.col("n") >= least).drop("n")
    wide = _bands(measured, ["lang_key"]).filter(F.col("n") >= least).drop("n")
    wide = wide.select("lang_key", *(F.col(c).alias(f"{c}_wide") for c in wide.columns if c != "lang_key"))
    held = measured.join(F.broadcast(fine), ["lang_key", "size_class"], "left").join(F.broadcast(wide), "lang_key", "left")
    outside = F.lit(False)
    for m in MEASURES:
        far = F.abs(F.col(m) - F.coalesce(f"{m}_mid", f"{m}_mid_wide")) > width * F.coalesce(f"{m}_dev", f"{m}_dev_wide")
        outside = outside | F.coalesce(far, F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return held.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~outside).alias("kept"), "n_tokens", *MEASURES, "lang_key")
