import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cytolith.llm import op6_pii as op


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def brute(text):
    text = text or ""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def texts():
    rng = random.Random(6)
    made = [None, "", "a@b.c_x@d.e.f a@b.c.@d.e", "1.2.3.4.5 999.1.1.1 01.002.255.0255", "4111 1111 1111 1111 4111-1111-1111-1111-", "1 2" * 3000, "+1 (499) 555-6503%%% +12345 +1234567890123456", "9" * 20_000, "a." * 10_000 + "@", "a@" + "b." * 5000, "1." * 5000, "+1" + "-" * 5000, "x" * 50_000 + "@y.zz", "é😀 a@b.cc"]
    parts = ["a", "b.", "@", "@c.d", ".", "-", "_", "1", "25", "256", "1.1.1.1", "4111111111111111", " ", "+", "+49 30 ", "(0)", "é", "\n", "x@y.z"]
    return made + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]


def test_base_spans_against_brute_force(documents):
    made = texts()
    rows = {r["doc_id"]: r for r in op.report(documents(made)).collect()}
    assert len(rows) == len(made)
    for k, text in enumerate(made):
        found = brute(text)
        assert [rows[k][f"n_{x}"] for x in op.KINDS] == [sum(f[0] == j for f in found) for j in range(4)], text
        listed = ",".join(f"{op.KINDS[j]}:{a}:{b}" for j, a, b in found)
        assert rows[k]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert rows[k]["spans"].startswith(listed)


def sanitised(made):
    """Listed spans of each text by the definition, over all pairs of entities and terms of a document."""
    base = [brute(t) for t in made]
    entities = [{(j, (t or "")[a:b].lower()) for j, a, b in spans} for t, spans in zip(made, base, strict=True)]
    n_term, n_entity, n_both = Counter(), Counter(), Counter()
    places = []
    for text, spans, mine in zip(made, base, entities, strict=True):
        n_term.update({w.lower() for w in WORD.findall(text or "")})
        n_entity.update(mine)
        blanked = list(text or "")
        for _, a, b in spans:
            blanked[a:b] = " " * (b - a)
        places.append([(m.start(), m.end(), m[0].lower()) for m in WORD.finditer("".join(blanked))])
        n_both.update({(w, e) for _, _, w in places[-1] for e in mine})
    out = []
    for spans, mine, held in zip(base, entities, places, strict=True):
        listed = [f"{op.KINDS[j]}:{a}:{b}" for j, a, b in spans]
        for a, b, w in held:
            values = [0.0]
            for e in mine:
                p = n_entity[e] / len(made)
                if p < 1:
                    values.append(1 + math.log((n_both[w, e] + p) / (n_term[w] + 1)) / -math.log(p))
            if max(values) >= op.GENERALISE:
                listed.append(f"term:{a}:{b}")
        out.append(",".join(listed))
    return out


WORD = re.compile(r"[^\W\d_]+")


def mentions():
    """Documents that share entities and words in many ways."""
    rng = random.Random(16)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("an", "el", "ino", "a", "u", "É")]
    entities = ["a@b.cc", "bo@c.dd", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111", "zed@y.zz"]
    made = [None, "", "no entity here"]
    for k in range(150):
        part = [rng.choice(words) for _ in range(rng.randrange(1, 12))] + [f"only{chr(97 + k % 26)}{chr(97 + k // 26)}"] * rng.randrange(2)
        part += [rng.choice(entities) for _ in range(rng.choice((0, 0, 1, 1, 2)))]
        if "a@b.cc" in part:
            part += ["Smith"] * 2 + ["jones"] * rng.randrange(2)
        rng.shuffle(part)
        made.append(rng.choice([" ", ", "]).join(part))
    return made + ["x.y@unique.org and Único Name", "a@b.cc+49 30 1234567 touches"]


def test_listed_spans_against_brute_force(documents):
    made = mentions()
    wanted = sanitised(made)
    got = {r["doc_id"]: r["spans"] for r in op.report(documents(made)).collect()}
    assert [got[k] for k in range(len(made))] == wanted
    assert sum("term" in w for w in wanted) > 15 and wanted[2] == ""


def test_terms_of_one_document_and_of_several(documents):
    texts = [f"write to agent Smith at a@b.cc today {w}" for w in ("one", "two", "three")] + ["write to nobody today"] * 60 + ["clean text about agent houses"] * 40 + ["ask Miller, m@ll.er, today"]
    docs = documents(texts)
    words = lambda row: {(texts[row["doc_id"]][s["start"] : s["end"]], s["kind"], s["name"]) for s in row["terms"]}
    rows = {r["doc_id"]: r for r in op.hits(docs).collect()}
    assert words(rows[0]) >= {("Smith", 5, "name"), ("at", 5, "term"), ("one", 4, "term")} or words(rows[0]) >= {("Smith", 4, "name"), ("one", 4, "term")}
    assert not {w for w, _, _ in words(rows[0])} & {"write", "to", "agent", "today"}
    assert {w for w, _, _ in words(rows[103])} == {"ask", "Miller"}
    assert all(not rows[k]["terms"] and not rows[k]["base"] for k in range(3, 103))


def test_far_terms_count_too(documents):
    texts = ["Zabor " + "the common words of a text " * 40 + "z@b.or"] + ["the common words of a text "] * 30
    spans = {r["doc_id"]: r["spans"] for r in op.report(documents(texts)).collect()}
    assert "term:0:5" in spans[0] and spans[1] == ""


def test_very_long_text(documents):
    made = {1: "a@b.cc the 1.2.3.4 word " * 100_000 + "Smith", 2: "the word " * 500_000, 3: "the word", 4: "x" * 5_000_000}
    rows = {r["doc_id"]: r for r in op.report(documents(made)).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[2]["spans"], rows[4]["spans"]) == (100_000, 100_000, "", "")


def test_repeated_null_and_empty_rows(documents):
    rows = op.report(documents([(1, "a@b.cc x"), (1, "a@b.cc x"), (None, "1.2.3.4"), (None, None)])).collect()
    assert sorted((r["n_email"], r["n_ip"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 0)]
    assert op.report(documents([])).count() == 0


def test_sanitised_text_has_no_base_span(documents):
    docs = documents([f"write to agent smith at a@b.cc today {w}, card 4111 1111 1111 1111" for w in ("one", "two", "three")] + ["write to nobody today"] * 6 + [None])
    done = op.sanitise(docs)
    assert done.columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in done.collect()}
    assert out[3] == "write to nobody today" and out[9] is None
    assert "a@b.cc" not in out[0] and "[email]" in out[0] and "[card]" in out[0] and "smith" not in out[0]
    listed = {r["doc_id"]: r["spans"] for r in op.report(docs).collect()}
    assert out[0].count("[") <= len(listed[0].split(","))


def test_main_path_is_native(documents):
    plan = op.report(documents(["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert documents(["4111111111111111"]).select(op.luhn(F.col("text"))).first()[0]
