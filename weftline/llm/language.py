"""Problem 8: the language of documents and of their lines.

Method: sparse multinomial logistic regression on TF-IDF character n-grams
(orders 1 and 3, hashed), fitted by follow-the-regularised-leader with an
elastic net on lines of a bounded sample of labelled documents, then softened
by a temperature chosen on held-out lines.  Wrong labels in the sample are
left out by a second fit.  A further class, ``zxx``, is fitted on placeholder
text and takes filler, which has no language.

Plan: one scan of the documents; no shuffle.  The model is a table of
2**16 x 9 floats, whatever the size of the data.  Sample: at most
``SAMPLE_DOCUMENTS`` documents a language and ``SAMPLE_LINES`` lines each.

Defined results
  * null or empty text, or no line with enough letters: no language;
  * ties between languages: the smaller code;
  * a label names a language by code, three-letter code or name, with or
    without region or script, in any case; null, blank or any other text names
    none of ``langs`` and is wrong wherever the document has a language;
  * an empty table, or one without any usable label, gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.grams import LinearModel, fold, softmax, train
from weftline.session import ship

MIN_LETTERS = 30
SAMPLE_DOCUMENTS = 150
SAMPLE_LINES = 40
SAMPLE_CHARS = 1000
NONE = "zxx"
#: Weight of "the line is in the language of its document" against any one other language.
SAME = 20.0
MAX_LANGUAGES = 1000

#: Words of the usual Latin placeholder text.
PLACEHOLDER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum tellus pellentesque viverra vestibulum luctus ornare quam tempus"
).split()

_SLOT = re.compile(r"\{\{.*?\}\}+|\$?\{[^{}\n]*\}|\{%.*?%\}|<%.*?%>|#\{[^{}\n]*\}|%%\w+%%|%[A-Z_]{3,}%|@@\w+@@|__\w+?__|\[\[[^\]\n]*\]\]|\$\w+\$|<[a-z_.]+\d*>|\[[A-Z_ ]{3,}\]")


def language_table(langs: DataFrame) -> dict[str, str]:
    """Every name of a language in lower case -> its code; from the reference table, whose size is checked."""
    rows = langs.select("lang", "iso3", "label").where("lang IS NOT NULL").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: not a reference table")
    return {str(name).strip().lower(): r["lang"] for r in rows for name in (r["label"], r["iso3"], r["lang"]) if name}


def label_code(names: dict[str, str], label: str | None) -> str | None:
    """The code that a label names, or None."""
    if not label:
        return None
    text = label.strip().lower()
    return names.get(text) or names.get(re.split(r"[-_@.\s]", text)[0])


def code_column(names: dict[str, str], label: Column) -> Column:
    """:func:`label_code` as a Spark expression."""
    if not names:
        return F.lit(None).cast("string")
    text = F.lower(F.trim(label))
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, text), F.try_element_at(lookup, F.split(text, r"[-_@.\s]")[0]))


def sample_lines(documents: DataFrame, names: dict[str, str], per_language: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """(code, line) of a bounded sample of labelled documents, the same on every run.

    A document is in if the hash of its id lies below a bound set by the size
    of its language, so no language crowds out another.
    """
    coded = documents.select(F.xxhash64("doc_id").alias("h"), code_column(names, F.col("lang")).alias("code"), "text").where("code IS NOT NULL AND text <> ''")
    sizes = {r["code"]: r["n"] for r in coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    bound = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, per_language / n))])
    share = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    line = F.transform(F.slice(F.split("text", "\n"), 1, SAMPLE_LINES), lambda x: F.substring(x, 1, SAMPLE_CHARS))
    rows = coded.where(share < F.try_element_at(bound, F.col("code"))).select("h", "code", line.alias("lines")).limit(2 * per_language * len(sizes)).collect()
    return [(r["code"], x) for r in sorted(rows, key=lambda r: r["h"]) for x in r["lines"]]


def placeholder_lines(n: int, seed: int = 11) -> list[str]:
    """Lines of placeholder text, whole and shortened words mixed, to fit the class without a language."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = rng.choice(PLACEHOLDER_WORDS, rng.integers(5, 40))
        short = rng.random(len(words)) < 0.4
        out.append(" ".join(w[:6] if s else w for w, s in zip(words, short)))
    return out


def fit_languages(documents: DataFrame, langs: DataFrame, per_language: int = SAMPLE_DOCUMENTS) -> tuple[LinearModel | None, dict[str, str]]:
    """The fitted model (None without labelled text) and the names of the languages."""
    names = language_table(langs)
    rows = [(c, x) for c, x in sample_lines(documents, names, per_language) if sum(map(str.isalpha, x)) >= 15 and not _SLOT.search(x) and "lorem" not in x.lower()]
    codes = sorted({c for c, _ in rows})
    if not codes:
        return None, names
    filler = placeholder_lines(max(200, len(rows) // (len(codes) + 1)))
    labels = [*codes, NONE]
    target = np.array([codes.index(c) for c, _ in rows] + [len(codes)] * len(filler))
    return train([x for _, x in rows] + filler, target, labels, clean=0.3), names


_MARKS = re.compile(r"[{}%@_\[$<]")


def _bare(line: str) -> bool:
    """Nothing but template fields, or a few words over and over."""
    rest = _SLOT.sub(" ", line) if _MARKS.search(line) else line
    words = rest.lower().split()
    seen: set[str] = set()
    for w in words:  # most lines show a third word soon
        if any(map(str.isalpha, w)):
            seen.add(w)
            if len(seen) > 2:
                return False
    return not seen or len(words) >= 4


def score_batch(model: LinearModel, texts: list[str], min_letters: int = MIN_LETTERS) -> dict[str, np.ndarray]:
    """Lines with enough letters and a language: text index, line number, class and log-probabilities; and each text's language."""
    lines = fold(texts)
    score = model.scores(lines)
    none = model.labels.index(NONE)
    long_enough = np.flatnonzero(lines.letters >= min_letters)
    spoken = long_enough[score[long_enough].argmax(axis=1) != none]
    t, no = lines.text_of[spoken], lines.number[spoken]
    parts: dict[int, list[str]] = {}
    keep = np.ones(len(spoken), dtype=bool)
    for j in range(len(spoken)):
        i = int(t[j])
        if i not in parts:
            parts[i] = texts[i].split("\n")
        keep[j] = not _bare(parts[i][no[j]])
    spoken, t, no = spoken[keep], t[keep], no[keep]
    codes = len(model.labels) - 1
    s = score[spoken][:, :codes]
    log_p = s - s.max(axis=1, keepdims=True)
    log_p -= np.log(np.exp(log_p).sum(axis=1, keepdims=True))
    letters = lines.letters[spoken]
    # a document's language is that of most letters; lines then stay with it unless they speak clearly against it
    mass = np.zeros((len(texts), codes))
    np.add.at(mass, (t, log_p.argmax(axis=1)), letters)
    own = mass.argmax(axis=1)
    has = mass.max(axis=1) > 0
    for _ in range(1):
        prior = np.zeros_like(log_p)
        prior[np.arange(len(t)), own[t]] = np.log(SAME)
        cls = (log_p + prior).argmax(axis=1)
        mass = np.zeros((len(texts), codes))
        np.add.at(mass, (t, cls), letters)
        own = mass.argmax(axis=1)
    total = np.maximum(mass.sum(axis=1), 1)
    p = softmax(log_p + prior)[np.arange(len(t)), cls] if len(t) else np.zeros(0)
    # confidence of a document: mean probability of its language, weighted by letters
    sure = np.bincount(t, weights=letters * np.where(cls == own[t], p, 0), minlength=len(texts)) / np.maximum(np.bincount(t, weights=letters * (cls == own[t]), minlength=len(texts)), 1)
    share = mass[np.arange(len(texts)), own] / total
    return {"text": t, "line": no, "cls": cls, "p": p, "own": own, "has": has, "sure": sure, "share": share}


SCHEMA = "doc_id long, line_no int, lang string, confidence double, label string, label_code string"


def languages(documents: DataFrame, langs: DataFrame, model: LinearModel | None = None, every: bool = True) -> DataFrame:
    """Languages of documents (line_no -1) and of the lines that differ from their document.

    With ``every=False`` a document's own row is left out where its label is right.
    """
    spark = ship(documents.sparkSession)
    if model is None:
        model, names = fit_languages(documents, langs)
    else:
        names = language_table(langs)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LinearModel = shared.value
        codes = np.array(m.labels, dtype=object)
        for batch in batches:
            ids, labels, text = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            a = 0
            sizes = np.cumsum([0, *(len(x or "") for x in text.to_pylist())])
            while a < len(labels):  # about a million characters at a time
                b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + 1_000_000, side="right")) - 1)
                r = score_batch(m, [x or "" for x in text.slice(a, b - a).to_pylist()])
                own_code = [label_code(names, x) for x in labels[a:b]]
                lang = codes[r["own"]]
                wrong = np.array([c != g for c, g in zip(own_code, lang)], dtype=bool)
                docs = np.flatnonzero(r["has"] & (wrong | every))
                other = np.flatnonzero(r["cls"] != r["own"][r["text"]])
                who = np.concatenate((docs, r["text"][other]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(who + a, pa.int64())),
                        pa.array(np.concatenate((np.full(len(docs), -1), r["line"][other])), pa.int32()),
                        pa.array([*lang[docs], *codes[r["cls"][other]]], pa.string()),
                        pa.array(np.concatenate((r["sure"][docs] * r["share"][docs], r["p"][other])), pa.float64()),
                        pa.array([labels[a + i] for i in who], pa.string()),
                        pa.array([own_code[i] for i in who], pa.string()),
                    ],
                    names=["doc_id", "line_no", "lang", "confidence", "label", "label_code"],
                )
                a = b

    return documents.select("doc_id", "lang", "text").where("text <> ''").mapInArrow(run, SCHEMA)


def wrong_languages(documents: DataFrame, langs: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang): documents whose label is missing or wrong (line_no -1), and lines in another language."""
    return languages(documents, langs, every=False).select("doc_id", "line_no", "lang")
