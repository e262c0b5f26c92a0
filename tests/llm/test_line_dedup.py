import random
import re

from tesseral.llm import line_dedup

SCHEMA = "doc_id long, text string, n_removed string"


def brute(rows):
    """Results by (doc_id, text); rows must be in order of the identifiers and distinct."""
    seen, out = set(), {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x)]
        norm = [re.sub("[\x20\x09-\x0d]+", " ", lines[i].lower()).strip(" ") for i in worded]
        gone = set()
        for at in range(len(worded) - 2):
            w = tuple(norm[at : at + 3])
            if w in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(w)
        drop = {worded[k] for k in gone}
        kept = [x for i, x in enumerate(lines) if i not in drop]
        out[doc_id] = (len(worded), len(gone), "\n".join(kept) if gone else text)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(9)] + ["", "  ", "Shared  Header", "é à"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 25)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a\nb"), (63, "x\n" * 5000), (64, rows[3][1])]
    got = line_dedup.dedupe(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(4)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.clean_text) for r in got} == want
    for r in got:
        assert r.n_removed == sum(int(b) - int(a) + 1 for a, b in (s.split("-") for s in r.removed_spans.split(",") if s))


def test_nulls_and_repeats(spark):
    text = "one\ntwo\nthree"
    rows = [(None, text, ""), (4, text, ""), (4, text, ""), (9, text + "\nfour", "")]
    got = line_dedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("4", 0), ("4", 0), ("9", 3), ("None", 3)]
    assert line_dedup.dedupe(spark.createDataFrame([], SCHEMA)).collect() == []
