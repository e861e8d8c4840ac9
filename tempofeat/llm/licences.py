"""Licence scans by canonical digests of whole texts.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation, white space), and the digest of all of it is joined
with the digests of known licences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempofeat.llm.shared import small_batches

# Spellings that count as the same word.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "colour": "color",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "honour": "honor",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "https": "http",
}

# Spellings of two words or more that count as the same.
PHRASES = {
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "per cent": "percent",
    "sub license": "sublicense",
    "sub licenses": "sublicenses",
    "sub licensed": "sublicensed",
    "sub licensing": "sublicensing",
}

# Public licence texts and notices by identifier; forms() adds the long ones and other usual forms.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}

# Lines that files put above a licence's text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "MIT-0": ("MIT No Attribution", "MIT-0"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"),
}

_COPYRIGHT = re.compile(r"^\W*(portions )?(copyright\b|©|\(c\)\s|all rights reserved).*$", re.MULTILINE)
_MARKS = ("copyright", "©", "(c)", "all rights reserved")
_ODD = re.compile(r"[\W_]+")


def canonical(text: str) -> str:
    """The canonical form of a text; what it leaves of "©" lines is nothing."""
    text = text.lower()
    if any(m in text for m in _MARKS):
        text = _COPYRIGHT.sub("", text)
    get = EQUIVALENT.get
    out = " ".join([get(w, w) for w in _ODD.sub(" ", text).split()])
    for phrase, same in PHRASES.items():
        if phrase in out:
            out = f" {out} ".replace(f" {phrase} ", f" {same} ").strip()
    return out


def forms(name: str, text: str) -> dict[str, str]:
    """A licence's text and the usual other forms that have another canonical text.

    Their names are the licence's with ": " and what is different. The forms
    are: one line a paragraph (lines that begin with "copyright" differ by
    wrapping), nothing after the end of the terms, bullets for numbers (BSD),
    and the titles of TITLES above each of these."""
    out = {name: text}
    for label, change in (
        ("without appendix", lambda t: t[: t.index(_END) + len(_END)] if _END in t else t),
        ("bullets", lambda t: re.sub(r"(?m)^\s*\d\. ", "* ", t) if name.startswith("BSD") else t),
        ("unwrapped", lambda t: re.sub(r"[^\S\n]*\n(?!\s*(\n|\d\. |\* |copyright \(c\)))[^\S\n]*", " ", t, flags=re.IGNORECASE)),
    ):
        out |= {f"{k}, {label}" if ":" in k else f"{k}: {label}": change(t) for k, t in out.items()}
    out |= {f"{k}, {title}" if ":" in k else f"{k}: {title}": f"{title}\n\n{t}" for k, t in out.items() for title in TITLES.get(name, ())}
    first: dict[str, str] = {}
    for k, t in out.items():
        first.setdefault(canonical(t), k)
    return {k: out[k] for k in first.values()}


_END = "END OF TERMS AND CONDITIONS"
KNOWN |= {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in sorted(files("tempofeat.llm").joinpath("licence_texts").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}
KNOWN = {form: text for name, own in KNOWN.items() for form, text in forms(name, own).items()}


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def digests(texts: DataFrame, text_col: str = "text", out: str = "digest") -> DataFrame:
    """texts with the digest of the canonical form in place of the text.

    A text with no words, like a null text, has no digest: null."""
    small_batches(texts.sparkSession)
    rest = [c for c in texts.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = digest("")
        for b in batches:
            found = [digest(x.as_py() or "") for x in b.column(text_col)]
            own = pa.array([None if d == blank else d for d in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), own], [*rest, out])

    schema = texts.drop(text_col).withColumn(out, F.lit("").cast("string")).schema
    schema[out].nullable = True
    return texts.mapInArrow(run, schema)


def licence_table(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(known.items()), "licence string, text string")


def scan(docs: DataFrame, licences: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, digest and licence (null if the text is no known licence) of each row.

    Of licences with equal canonical texts the first name counts, so that no
    row of docs doubles; licences without words match nothing. Repeated rows
    and null ids stay; other columns are ignored, an empty table gives no rows,
    and a very long text is normalised whole. Known digests are broadcast up to `broadcast_rows`,
    counted, and else joined by a shuffle of digests alone.
    """
    known = digests(licences.select("licence", "text")).where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    rows = digests(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "licence", F.col("licence").isNotNull().alias("is_licence"))


def op10_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), licence_table(spark))
