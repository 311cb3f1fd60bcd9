"""License scans by sentence rules.

A text is cut into fragments at every line break, and at . ! ? : ; before white space; a fragment is normalised. A sentence is any run of
fragments, so one that is wrapped over lines, with or without comment marks, or that holds a colon, is found like any other. Where it
is, normalised, a known licence sentence, it becomes an identifier; a document's identifiers, in order, are matched against ordered licence
rules: a rule holds where its identifiers occur in this order, other sentences and identifiers between them being allowed. Of the rules
of one licence that hold, the one with the most sentences is reported (ties: the first in the table).

A built-in expression finds the texts that hold a word without which no known sentence can be there; only these are read in Python. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_table import RULES, SENTENCES

#: Every known sentence holds one of these.
GATE = r"licen[sc]|rights reserved|permission|redistribut|warrant|public\W+domain|confidential|unauthorized|copyright|software|(?:available|distributed|released)\W+under|\bcc0\b|\bmpl\b"
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?:;])[ \t]+")
_OTHER = re.compile(r"[^a-z0-9]+")


def _plain(wording: str) -> str:
    """Normalised: lower case, every run of characters other than a-z and 0-9 one space; {} stays, as a gap."""
    return " {} ".join(_OTHER.sub(" ", part.lower()).strip() for part in wording.split("{}")).strip()


def known() -> list[tuple[str, str]]:
    """(normalised wording, identifier), each once."""
    return sorted({(_plain(w), k) for k, ws in SENTENCES.items() for w in ws})


def _expression(wording: str) -> str:
    word = "(?: |\\|\\|)"
    out, words = "", wording.split(" ")
    for i, w in enumerate(words):
        if w != "{}":
            out += w + ("" if i == len(words) - 1 else word)
        elif i == len(words) - 1:
            out = out.removesuffix(word) + f"(?:{word}[a-z0-9]+){{0,10}}"
        else:
            out += f"(?:[a-z0-9]+{word}){{0,10}}"
    return out


def _probe(wording: str) -> str:
    """The longest of the first three words of a wording: a cheap test, and no more than that."""
    return max(wording.split("{}")[0].split(" ")[:3], key=len)


def patterns() -> list[tuple[str, str, str]]:
    """(probe, regular expression of RE2 and Python, identifier): the wordings of an identifier that share a probe, among fragments written |one||two|, the longest first."""
    groups: dict[tuple[str, str], list[str]] = {}
    for s, k in known():
        groups.setdefault((_probe(s), k), []).append(s)
    return [(probe, "\\|(?:" + "|".join(map(_expression, sorted(own, key=lambda s: (-len(s), s)))) + ")\\|", k) for (probe, k), own in sorted(groups.items())]


def fragments(text: str) -> str:
    """|fragment||fragment|... of a text, normalised."""
    parts = (_OTHER.sub(" ", p).strip() for p in _BREAK.split(text.lower()))
    return "".join(f"|{p}|" for p in parts if p)


class Matcher:
    def __init__(self) -> None:
        self.patterns = [(re.compile(p), probe, k) for probe, p, k in patterns()]

    def identifiers(self, text: str) -> list[str]:
        """The licence identifiers of a text in order: of those that begin at one fragment the longest (ties: the first by name)."""
        own = fragments(text)
        words = set(own.replace("|", " ").split(" "))
        best: dict[int, tuple[int, str]] = {}
        for p, probe, k in self.patterns:
            if probe and probe not in words:
                continue
            at = 0
            while m := p.search(own, at):
                here = (m.start() - m.end(), k)
                best[m.start()] = min(best.get(m.start(), here), here)
                at = m.end()
        return [best[i][1] for i in sorted(best)]


def rule_hits(ids: list[str]) -> list[tuple[str, str, int]]:
    """(licence, rule, sentences) of a sequence of identifiers."""
    best: dict[str, tuple[str, str, int]] = {}
    for name, lic, seq in RULES:
        left = iter(ids)
        if all(k in left for k in seq) and (lic not in best or len(seq) > best[lic][2]):
            best[lic] = (lic, name, len(seq))
    return list(best.values())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, rule, n_sentences, sentences): one row for each document and licence whose rule holds.

    `sentences` lists all licence identifiers of the document in order, repeats included. A null or empty text has no sentence and gives no
    row. Repeated rows each give their rows; a null doc_id stays null. Other columns are ignored. An empty table gives an empty
    result. Whole texts are read, whatever their length, and sentences of any length.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids := matcher.identifiers(text):
                    rows += [(i, *hit, " ".join(ids)) for hit in rule_hits(ids)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["doc_id", "license", "rule", "n_sentences", "sentences"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.string() if dict(own.dtypes)["doc_id"] == "string" else pa.int64()
    if kind == pa.int64():
        own = own.withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.where(F.col("text").rlike(f"(?i){GATE}")).mapInArrow(scan, f"doc_id {dict(own.dtypes)['doc_id']}, license string, rule string, n_sentences int, sentences string")


def license_sql() -> str:
    """The same in DuckDB SQL over `documents`, by its own regular expressions and positions."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(probe)}, {q(p)}, {q(k)})" for probe, p, k in patterns())
    rules = ", ".join(f"({i}, {q(n)}, {q(lic)}, {len(seq)}, {q('%' + '%'.join(f',{k},' for k in seq).replace('_', chr(92) + '_') + '%')})" for i, (n, lic, seq) in enumerate(RULES))
    return f"""
WITH known(probe, pat, k) AS (VALUES {rows}), rules(i, rule, license, n, seq) AS (VALUES {rules}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(lower(text), '([.!?:;])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS fs FROM documents WHERE regexp_matches(lower(text), {q(GATE)})),
own AS (SELECT r, doc_id, array_to_string(list_transform(list_filter(list_transform(fs, lambda f: trim(regexp_replace(f, '[^a-z0-9]+', ' ', 'g'))), lambda f: f != ''), lambda f: '|' || f || '|'), '') AS a FROM texts),
hit AS (SELECT r, doc_id, k, a, pat, regexp_extract_all(a, pat) AS found, string_split_regex(a, pat) AS between FROM own JOIN known ON contains(a, probe) AND regexp_matches(a, pat)),
each_hit AS (SELECT r, doc_id, k, unnest(found) AS f, generate_subscripts(found, 1) AS nth, found, between FROM hit),
at_hit AS (SELECT r, doc_id, k, length(f) AS size, list_sum(list_transform(between[1:nth], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:nth - 1], lambda x: length(x))), 0) AS pos FROM each_hit),
ids AS (SELECT r, doc_id, pos, first(k ORDER BY size DESC, k) AS k FROM at_hit GROUP BY r, doc_id, pos),
seqs AS (SELECT r, doc_id, string_agg(k, ' ' ORDER BY pos) AS sentences, ',' || string_agg(k, ',,' ORDER BY pos) || ',' AS seq FROM ids GROUP BY r, doc_id),
hits AS (SELECT r, doc_id, license, rule, n, sentences, row_number() OVER (PARTITION BY r, license ORDER BY n DESC, i) AS best FROM seqs JOIN rules ON seqs.seq LIKE rules.seq ESCAPE '\\')
SELECT doc_id, license, rule, n::INTEGER AS n_sentences, sentences FROM hits WHERE best = 1
"""
