import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tesseral.llm import pii, queries
from tesseral.llm.common import SPACE

SCHEMA = "doc_id long, text string, pii_spans string"

# the contract's patterns as they stand there
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), kind, m.group()) for m in re.finditer(pattern, text or "") if holds(kind, m.group())]
    return sorted(out)


def brute(texts, meetings=1):
    """Spans of each distinct text, the terms' included."""
    found = {t: brute_base(t) for t in texts}
    near, seen = defaultdict(set), defaultdict(set)
    places = defaultdict(set)
    for t, own in found.items():
        for kind in BASE:
            every = [m for m in re.finditer(BASE[kind], t)]
            for i, m in enumerate(every):
                if not holds(kind, m.group()):
                    continue
                entity = (kind, m.group())
                seen[entity].add(t)
                lo = max(every[i - 1].end() if i else 0, m.start() - pii.CONTEXT_CHARS)
                hi = min(every[i + 1].start() if i + 1 < len(every) else len(t), m.end() + pii.CONTEXT_CHARS)
                for begin, part in ((lo, t[lo : m.start()]), (m.end(), t[m.end() : hi])):
                    at, words = begin, re.split(pii.SPACE_CHAR, part)
                    for k, w in enumerate(words):
                        if 0 < k < len(words) - 1 and w.isalpha():
                            near[entity, w.lower()].add(t)
                            places[t, entity, w.lower()].add((at, at + len(w)))
                        at += len(w) + 1
    uses = defaultdict(set)
    for t in texts:
        for w in re.split(SPACE, t.lower()):
            uses[w].add(t)
    out = {}
    for t in texts:
        extra = {}
        for (where, entity, term), at in places.items():
            n_e, n_et = len(seen[entity]), len(near[entity, term])
            if where != t or n_et < pii.MIN_TEXTS or n_e >= len(texts) or n_et < meetings and len(uses[term]) > 1:
                continue
            share = 1 + math.log(n_et / len(uses[term])) / math.log(len(texts) / n_e)
            if share >= pii.GENERALISE_FROM:
                for a, b in at:
                    extra[a, b] = max(extra.get((a, b), 0), share)
        out[t] = sorted([(a, r, b, k) for a, r, b, k, _ in found[t]] + [(a, 4, b, "term") for a, b in extra])
    return out


def made():
    rng = random.Random(8)
    filler = ["alpha", "beta", "gamma", "Delta", "é", "x1", "the", "of"]
    pieces = [
        "a.b@c.d.org", "x@y", "@z.com", "q%w+e@mail-1.example.com.", "a@b.c_foo@x.y", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.3.255",
        "4111 1111 1111 1111", "4466865973537603", "4111-1111-1111-1112", "12", "+1 (741) 555-3069", "+123", "+49 30 1234567 89", "++1 22", "😀", "0" * 30,
    ]
    texts = ["", "a@b.cc", "éé x@y.zz 😀 1.2.3.4", " ".join(pieces)]
    for _ in range(30):
        parts = rng.choices(filler, k=rng.randint(5, 40))
        for _ in range(rng.randint(0, 5)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(pieces))
        texts.append(rng.choice([" ", "\n", ". "]).join(parts))
    for i in range(6):
        texts.append(f"note {i} of patient zorblax with contact zed@clinic.org at ward seven {'of the ' * i}")
    return texts


@pytest.mark.parametrize("meetings", [1, 2])
def test_spans_equal_brute_force(spark, meetings):
    texts = made()
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(99, None, ""), (5, texts[5], ""), (5, texts[5], "")]
    got = pii.find(spark.createDataFrame(rows, SCHEMA).repartition(3), meetings=meetings).collect()
    assert len(got) == len(rows)
    want = brute(list(dict.fromkeys(texts)), meetings)
    for r in got:
        assert [(s.start, s.rank, s.end, s.kind) for s in r.pii_spans] == want[r.text or ""], r.text
    terms = {s.value for r in got for s in r.pii_spans if s.kind == "term"}
    assert "zorblax" in terms and "the" not in terms


def test_sanitised_text(spark):
    texts = made()
    got = pii.sanitise(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        if not r.pii_spans:
            assert r.clean_text == r.text
    by = {r.doc_id: r.clean_text for r in got}
    assert by[1] == "[EMAIL]" and by[2] == "éé [EMAIL] 😀 [IP]"
    note = by[len(texts) - 6]
    assert "zorblax" not in note and "clinic" not in note and note.startswith("note 0 of")


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 2_000_000 + "@", "1" * 300_000, "1 " * 300_000, "+1" + "(" * 300_000, "1.2.3." * 2_000, "a@b." * 2_000]
    got = pii.find(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        if r.doc_id < 4:
            assert r.pii_spans == []
        else:
            assert [(s.start, s.rank, s.end, s.kind) for s in r.pii_spans] == [m[:4] for m in brute_base(r.text)], r.doc_id


def test_digest_of_nothing_and_empty_table(spark):
    from pyspark.sql import functions as F

    one = pii.find(spark.createDataFrame([(1, None, None)], SCHEMA)).select(F.sha2(pii.listed(F.col("pii_spans")), 256)).first()[0]
    assert one == hashlib.sha256(b"").hexdigest()
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_of_an_entity_in_one_text(spark):
    texts = [f"plain filler number {i} with words" for i in range(40)]
    texts.append("so we asked quillon with words for ada@home.org and with words again")
    got = pii.find(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    terms = {s.value: s.share for r in got for s in r.pii_spans if s.kind == "term"}
    assert terms["quillon"] == 1.0 and "with" not in terms


def test_disclosing_terms_go_wherever_they_stand(spark):
    texts = [f"plain filler number {i} with words" for i in range(400)]
    texts += [
        "so we asked (Quillon), with case A1234: words, for ada@home.org and with words again",
        "Quillon's file: A1234, with words",
        "words with. «quillon»! " + "with words " * 40 + "quillon",
    ]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    by = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    found = {i: {(s.start, s.end, s.value) for s in by[i].pii_spans if s.kind == "term"} for i in (400, 401, 402)}
    want = {(texts[400].index(w), texts[400].index(w) + len(w), w.lower()) for w in ("we", "asked", "Quillon", "case", "A1234", "for", "and", "again")}
    assert found[400] <= want and {v for _, _, v in found[400]} >= {"quillon", "a1234"}
    assert found[401] == {(0, 7, "quillon"), (texts[401].index("A1234"), texts[401].index("A1234") + 5, "a1234")}
    assert found[402] == {(m, m + 7, "quillon") for m in (texts[402].index("quillon"), texts[402].rindex("quillon"))}
    assert "quillon" not in by[402].clean_text and "A1234" not in by[400].clean_text + by[401].clean_text


def test_chance_neighbours_stay_and_planted_names_go(spark):
    rng = random.Random(3)
    rare = [f"rare{i}x" for i in range(3000)]
    texts, planted, chance = [], {}, set()
    for i in range(400):  # each rare word stands in two texts; every tenth text has an address of its own
        own = [rng.choice(rare) for _ in range(15)] + ["the", "of", "and"] * 4
        rng.shuffle(own)
        if i % 10 == 0:
            at = 4 + rng.randrange(10)
            chance |= set(own[at - 3 : at + 3])
            own[at:at] = [f"someone{i}@mail.example"]
        texts.append(" ".join(own))
    for k in range(12):  # a name that stands by its address, in three texts, and nowhere else
        for j in range(3):
            own = rng.sample(rare[250 * k : 250 * k + 250][83 * j : 83 * j + 83], 10)
            own[5:5] = ["to", f"Name{chr(97 + k)}quist", f"person{k}@home.example", "as", "agreed"]
            planted[len(texts)] = f"name{chr(97 + k)}quist"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: {s.value.lower() for s in r.pii_spans if s.kind == "term"} for r in pii.find(docs, meetings=2).collect()}
    assert all(name in found[i] for i, name in planted.items())
    without = [i for i, t in enumerate(texts) if "@" not in t]
    assert not any(found[i] for i in without)
    plain = {r.doc_id: [s for s in r.pii_spans if s.kind == "term"] for r in pii.find(docs).collect()}
    assert any(plain[i] for i in without)  # which the plain estimate does mark


def test_query_and_its_sql_mark_terms_that_met_their_entity_once(spark, tmp_path):
    # as the general estimate has it: one meeting is enough, also for a term that other texts have
    texts = [f"filler text {i} of the corpus" for i in range(400)]
    texts += ["see to quillon at q@home.example as was agreed", "the quillon of another text"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert "term:7:14" in got[400].split(",") and got[401] == "term:4:11"
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(duck.sql(f"select doc_id, spans from ({queries.OP5_SQL})").fetchall())
