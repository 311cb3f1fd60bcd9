import random
import re
import textwrap

import pytest

from gridloom.llm.license_scan import GATE, Matcher, known, license_scan, rule_hits
from gridloom.llm.license_table import RULES, SENTENCES


@pytest.fixture(scope="module")
def matcher():
    return Matcher()


def scan(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return sorted((r.doc_id, r.license, r.rule, r.n_sentences, r.sentences) for r in license_scan(df).collect())


def test_every_known_sentence_passes_the_gate():
    for s, _ in known():
        assert re.search(GATE, s), s


@pytest.mark.parametrize("wrap", [None, 30, 78])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_every_rule_matches_its_own_text(matcher, wrap, mark):
    for name, lic, seq in RULES:
        text = "\n\n".join(SENTENCES[k][-1].replace("{}", "the Foo Company") for k in seq)
        if wrap:
            text = "\n\n".join("\n".join(textwrap.wrap(p, wrap, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))
        text = "\n".join(mark + line for line in f"Foo.\n\n{text}\n\nbar".split("\n"))
        hits = {h[0]: h for h in rule_hits(matcher.identifiers(text))}
        assert lic in hits, (name, matcher.identifiers(text))
        assert hits[lic][2] >= len(seq), name


def test_whole_notices(matcher):
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */"""
    assert [h[1] for h in rule_hits(matcher.identifiers(gpl))] == ["gpl-3.0_notice_full"]
    mit = "MIT License\n\nCopyright (c) 2024 X\n\n" + "\n\n".join(textwrap.fill(SENTENCES[k][0], 78) for k in ("mit_grant", "mit_notice", "mit_asis"))
    assert [h[1] for h in rule_hits(matcher.identifiers(mit))] == ["mit_whole"]


def test_rules_need_their_order(spark):
    grant, source, binary = (SENTENCES[k][0] for k in ("bsd_grant", "bsd_source", "bsd_binary"))
    got = scan(spark, f"{grant}\n{source}\n{binary}", f"{source}\n{binary}\n{grant}", f"x. {grant} y. {source} z. All rights reserved. {binary}")
    assert [(g[0], g[2]) for g in got] == [(0, "bsd-2-clause"), (2, "bsd-2-clause"), (2, "all_rights")]


def test_only_whole_sentences(spark):
    got = scan(spark, "foo\n** LICENSED under the  Apache License; Version 2.0 **\nbar", "never released under the MIT License.", "Released under the MIT License. Really", "Released under the MIT License" + " " * 5000 + ".", "not all rights reserved by us. " * 9)
    assert [(g[0], g[2]) for g in got] == [(0, "apache-2.0_short"), (2, "mit_short"), (3, "mit_short")]


def test_against_sql(spark, data, duck, same):
    from gridloom.llm.queries import oracle_sql, queries

    same(queries()["op1_license_scan"](spark, data), duck.execute(oracle_sql()["op1_license_scan"]))


def test_against_sql_on_wrapped_and_mixed_notices(spark, same):
    import duckdb
    import pandas as pd

    from gridloom.llm.license_scan import license_sql

    rng = random.Random(3)
    parts = [w.replace("{}", "of Foo Bar") for ws in SENTENCES.values() for w in ws] + ["Some words of prose here.", "the quick brown: fox;", "All rights reserved. All rights reserved.", ""]
    texts = [(i, "\n".join(textwrap.fill(x, rng.choice([25, 60, 2000])) for x in rng.choices(parts, k=rng.randrange(1, 12)))) for i in range(150)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]))
    same(license_scan(spark.createDataFrame(texts, "doc_id long, text string")), con.execute(license_sql()))


def test_awkward(spark, awkward, nothing):
    assert license_scan(awkward).count() == 0
    assert license_scan(nothing).count() == 0
    two = spark.createDataFrame([(None, "All rights reserved.", 1)] * 2, "doc_id long, text string, license int")
    assert [tuple(r)[:3] for r in license_scan(two).collect()] == [(None, "Proprietary", "all_rights")] * 2
    assert license_scan(spark.createDataFrame([(1, "Word. " * 50_000 + "All rights reserved.")], "doc_id int, text string")).count() == 1


def test_a_wording_has_one_identifier():
    assert len({s for s, _ in known()}) == len(known())
