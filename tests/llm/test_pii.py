"""Base spans against the plain patterns; disclosing terms against brute force."""
import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coldlake.llm import pii

from .helpers import prose

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def plain_base(text):
    return sorted((m.start(), rank, m.end(), kind, m.group()) for rank, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(kind, m.group()))


TEXTS = ["mail a.b@c.de, x@y", "a@b.c_d@e.f a@b.cc@d.ee.", "@@a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "41111111111111111234567",
         "+1 (980) 555-6268 +49.30.1234567 +1+2 1234567890", "é漢\U0001f600 x@y.z \U0001f600 10.0.0.1", "5" * 5000, "1 " * 4000, "a" * 3000 + "@" + "b" * 10, "+1" + " " * 500 + "2345678901", "",
         "4111111111111111 x@y.zz +14155550100 1.2.3.4 " * 700, "00000000000000 0.0.0.0"]


def test_base_spans_match_the_plain_patterns(spark, make_docs, edge_rows):
    rows = edge_rows + [(50 + k, t) for k, t in enumerate(TEXTS)]
    got = defaultdict(list)
    for r in pii.find(make_docs(rows)).select("doc_id", pii.written(pii.base_by_start()).alias("s"), *[pii.count_of(k).alias(k) for k in pii.KINDS]).collect():
        got[r["doc_id"]].append((r["s"], [r[k] for k in pii.KINDS]))
    for i, t in rows:
        want = plain_base(t)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in want)
        assert (line, [sum(x[3] == k for x in want) for k in pii.KINDS]) in got[i], (i, (t or "")[:60])
        assert hashlib.sha256(line.encode()).hexdigest()
    assert sum(map(len, got.values())) == len(rows)


def disclosure_rows():
    rows = [(k, prose(k, 30) + f" contact Zorblatt at boss@corp.example now {prose(900 + k, 12)}") for k in range(5)]
    rows += [(10 + k, prose(40 + k, 60) + " contact at someone now") for k in range(30)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (60, "contact Quillfeather at one@only.example now")]
    return rows


def plain_terms(rows, window=64, threshold=0.8, min_texts=3):
    texts = {t for _, t in rows if t}
    spans = {t: plain_base(t) for t in texts}
    near, entity_texts = defaultdict(set), defaultdict(set)
    hits = []
    for t in texts:
        for a, rank, b, kind, m in spans[t]:
            value = m.lower() if kind == "email" else m
            prev = max((e for s, r, e, k, _ in spans[t] if k == kind and e <= a), default=0)
            after = min((s for s, r, e, k, _ in spans[t] if k == kind and s >= b), default=len(t))
            for lo, hi in ((max(prev, a - window), a), (b, min(after, b + window))):
                side = t[lo:hi]
                for w in re.finditer(r"[^\W\d_]{3,}", side):
                    if len(side) == window and ((lo < a and w.start() == 0) or (lo >= b and w.end() == len(side))):
                        continue
                    s, e = lo + w.start(), lo + w.end()
                    if not any(x < e and y > s for x, _, y, _, _ in spans[t]):
                        near[f"{kind}:{value}", w.group().lower()].add(t)
                        entity_texts[f"{kind}:{value}"].add(t)
                        hits.append((t, s, e, f"{kind}:{value}", w.group().lower()))
    n = len(set(t or "" for _, t in rows))
    words = {t: set(re.split(r"[\W\d_]+", t.lower())) for t in texts}
    guilty = set()
    for (v, w), both in near.items():
        n_term, n_entity = sum(w in words[t] for t in texts), len(entity_texts[v])
        if len(both) >= min_texts and n_entity < n and math.log2(len(both) * n / (n_term * n_entity)) / math.log2(n / n_entity) >= threshold:
            guilty.add((v, w))
    out = defaultdict(set)
    for t, s, e, v, w in hits:
        if (v, w) in guilty:
            out[t].add((s, e))
    return guilty, out


def test_disclosing_terms_match_brute_force(spark, make_docs):
    rows = disclosure_rows()
    guilty, want = plain_terms(rows)
    assert ("email:boss@corp.example", "zorblatt") in guilty and not any(w in ("contact", "quillfeather", "now") for _, w in guilty)
    got = pii.find(make_docs(rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert {(s["start"], s["end"]) for s in r["terms"]} == want[texts[r["doc_id"]]]


def test_sanitised_text(spark, make_docs):
    rows = disclosure_rows() + [(70, None), (71, "plain"), (72, "+1 (980) 555-6268 x")]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(make_docs(rows)).collect()}
    assert got[70] is None and got[71] == "plain" and got[72] == "[PHONE] x"
    assert "contact [TERM] at [EMAIL] now" in got[0] and "Quillfeather at [EMAIL]" in got[60] and len(got) == len(rows)


def test_empty_table_and_native_plan(spark, make_docs):
    assert pii.find(make_docs([])).count() == 0
    plan = pii.find(make_docs(disclosure_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("kind", pii.KINDS)
def test_patterns_are_linear(spark, kind):
    text = {"email": "a" * 200_000, "ip": "1" * 200_000, "card": "1 " * 100_000, "phone": "+1" + " " * 200_000}[kind]
    assert spark.createDataFrame([(text,)], "x string").select(F.size(F.regexp_extract_all("x", F.lit(pii.PATTERNS[kind]), F.lit(0)))).first()[0] in (0, 1)


def test_terms_are_found_over_whole_texts(spark, make_docs):
    rows = [(k, f"{prose(k, 30)} Zorblatt {prose(50 + k, 40)} 2024 staff@corp.example {prose(900 + k, 30)} zorblatt") for k in range(5)]
    rows += [(10 + k, prose(40 + k, 60)) for k in range(30)]
    texts = dict(rows)
    for r in pii.find(make_docs(rows)).collect():
        found = [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["terms"]]
        assert found.count("Zorblatt") == found.count("zorblatt") == (r["doc_id"] < 5)


def test_terms_of_rare_values_are_found_over_whole_texts(spark, make_docs):
    far = prose(7, 40)
    rows = [(k, f"{prose(k, 30)} Zorblatt {prose(50 + k, 40)} 2024 staff{k}@corp.example {prose(900 + k, 30)} zorblatt") for k in range(5)]
    rows += [(10 + k, prose(40 + k, 60)) for k in range(30)] + [(60, f"Quillfeather one@only.example {far}")]
    texts = dict(rows)
    for r in pii.find(make_docs(rows)).collect():
        found = [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["terms"]]
        assert found.count("Zorblatt") == found.count("zorblatt") == (r["doc_id"] < 5) and "Quillfeather" not in found
