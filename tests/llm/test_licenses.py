import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm import licenses as L

from . import cases


def test_base_against_brute_force(spark):
    got = {}
    for r in L.scan_licenses(cases.docs(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | set() and 0 <= r["score"] <= 1
    want = {}
    for i, t in cases.pairs():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases.low(t))
        places = [(k, label) for phrase, label in L.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want.setdefault(i, []).append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))))
    assert {k: cases.key(v) for k, v in got.items()} == {k: cases.key(v) for k, v in want.items()}


def labels(text):
    return [r.label for _, _, r in sorted(L.detections(b" ".join(L.C.words_of(text.encode()))), key=lambda d: d[0])]


def test_rules_and_suppression():
    assert len(L.rules()) > 200
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2"]
    assert labels("SPDX-License-Identifier: GPL-3.0 ... GNU Lesser General Public License v2.1") == ["gpl-3", "lgpl-2.1"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa"]
    assert labels("she can commit to it") == []


def test_empty(spark):
    assert L.scan_licenses(cases.docs(spark, [])).collect() == []


SHORT = [
    ("Released under the BSD 3-Clause", "bsd-3"), ("distributed under the terms of the Apache 2.0", "apache-2"), ("released under the Boost Software 1.0", "boost-1"),
    ("Distributed under the Common Development and Distribution", "cddl-1"), ("published under Artistic 2.0", "artistic-2"), ("the Llama 3 Community one", "llama"), ("under Elastic 2.0", "elastic-2"),
    ("Business Source 1.1", "bsl-1.1"), ("PHP 3.01", "php-3.01"), ("Creative Commons Zero 1.0", "cc0"), ("released by Mozilla Public 2.0", "mpl-2"), ("GPLv3", "gpl-3"), ("GPL-2.0-or-later", "gpl-2"),
    ("GNU LGPL v2.1", "lgpl-2.1"), ("Lesser GPL 3", "lgpl-3"), ("AGPL-3.0", "agpl-3"), ("Affero GPL version 3", "agpl-3"), ("MPL-2.0", "mpl-2"), ("EPL 2.0", "epl-2"), ("CDDL-1.0", "cddl-1"), ("BUSL-1.1", "bsl-1.1"),
    ("BSL-1.0", "boost-1"), ("WTFPL", "wtfpl"), ("EUPL-1.2", "eupl-1.2"), ("OFL-1.1", "ofl-1.1"), ("ODbL", "odbl-1"), ("GFDL 1.3", "gfdl-1.3"), ("SSPL-1.0", "sspl-1"),
]


def brute(found):
    """Suppression by the definition: detections (start, end, priority, rule)."""
    outer = lambda k, d: k[2] <= d[2] and k[0] <= d[0] and d[1] <= k[1] and ((k[0], -k[1], k[2], k[3]) < (d[0], -d[1], d[2], d[3]))
    return [d for d in found if not any(outer(k, d) for k in found)]


def ungated(text):
    """Labels by all rules, whatever words a text holds."""
    joined = b" " + b" ".join(L.C.words_of(text.encode())) + b" "
    found = [(m.start(), m.end(), r.priority, i) for i, r in enumerate(L.rules()) for m in r.pattern.finditer(joined)]
    return {L.rules()[i].label for *_, i in brute(found)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(0, 3)), max_size=25))
def test_suppression_against_its_definition(drawn):
    found = [(a, a + n, p, i) for i, (a, n, p) in enumerate(drawn)]
    assert sorted(L.suppressed(found)) == sorted(brute(found))


def test_a_megabyte_of_license_lines():
    lines = [*(t for t, _ in SHORT), "Licensed under the Apache License, Version 2.0; all rights reserved.", "released under the MIT license", "GNU General Public License v2 or later"]
    text = (". ".join(lines) + "\n").encode()
    text *= (1 << 20) // len(text)
    began = time.time()
    batch = L.pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text.decode()]})
    row = next(L._scan(iter([batch]))).to_pylist()[0]
    assert time.time() - began < 12 and row["n_base"] == text.lower().count(b"under the mit license") + text.lower().count(b"apache license, version 2")
    last = row["detections"].split(",")[-1].split(":")
    assert int(last[1]) == row["n_words"] and last[2] == "gpl-2"


def test_every_rule_runs_where_it_can_match(spark):
    texts = [t for t, _ in SHORT] + [f"{t}; we permit and accept it" for t, _ in SHORT] + ["nothing of that kind", "lesser gpl 2", *(t for _, t in cases.pairs())]
    texts += [f"{'...  ' * 3}{t.upper()}\n" for t, _ in SHORT]
    found = L.scan_licenses(cases.docs(spark, [(i, t, *(None,) * 7) for i, t in enumerate(texts)])).collect()
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))), r["score"] > 0) for r in found}
    base = {r["doc_id"]: set(filter(None, r["base_labels"].split(","))) for r in found}
    assert got == {i: (base[i] | ungated(t), bool(base[i] | ungated(t))) for i, t in enumerate(texts)}
    assert [got[i][0] for i in range(len(SHORT))] == [got[len(SHORT) + i][0] for i in range(len(SHORT))] == [{label} for _, label in SHORT]
