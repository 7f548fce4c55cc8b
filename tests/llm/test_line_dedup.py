from pyspark.sql import functions as F

from foliograph.llm import line_dedup


def brute_force(rows, min_sites):
    sites, first = {}, {}
    for d, text, source in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\n\r\x0b\x0c"):
                sites.setdefault(line, set()).update({source} - {None})
                first[line] = min(first.get(line, (d, pos)), (d, pos))
    out = []
    for d, text, _ in rows:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if len(sites.get(x, ())) < min_sites or first[x] == (d, i))
        out.append((d, kept))
    return sorted(out)


def test_against_exact_counts(docs):
    rows = []
    for i in range(240):
        lines = [f"own line {i}", "", "seen on all", f"on {i % 24} of them"]
        lines += ["at nine"] * (i % 24 < 9) + ["at ten"] * (i % 24 < 10) + ["at eleven", "at eleven"] * (i % 24 < 11)
        rows.append((i, "\n".join(lines), f"site{i % 24}"))
    rows += [(900, None, "site1"), (901, "", "site2"), (902, "seen on all\n", None), (903, "at nine", None)]
    found = line_dedup.dedup_lines(docs(*rows).withColumn("n_lines", F.lit("clash")))
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == brute_force(rows, line_dedup.MIN_SITES)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert (by_id[900]["n_lines"], by_id[901]["n_lines"], by_id[902]["n_removed"]) == (0, 1, 1)


def test_sketches_decide_far_from_the_threshold(docs):
    rows = [(i, "everywhere\nown " + str(i), f"s{i}") for i in range(300)] + [(1000 + i, "few\nmine " + str(i), f"s{i % 4}") for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(*rows)).collect()}
    assert got[0] == "everywhere\nown 0"
    assert got[7] == "own 7"
    assert got[1005] == "few\nmine 5"


def test_repeated_rows_and_empty_tables(docs):
    rows = [(i, "same line", f"s{i}") for i in range(12)] + [(None, "same line", "s1"), (4, "same line", "s4")]
    found = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(docs(*rows)).collect())
    assert len(found) == 14
    assert [t for _, t in found if t] == ["same line"]
    assert line_dedup.dedup_lines(docs()).count() == 0
