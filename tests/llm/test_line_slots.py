"""Look-up of a page's lines among many boilerplate lines of its host."""

import pytest

from lexvane.llm import line_dedup


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400])
def test_each_line_is_found_in_its_slot(spark, n):
    """Hosts of n boilerplate lines, two pages each; lines of one page, blank ones and those of pages without a host stay."""
    common = [f"menu entry {i}" for i in range(n)]
    rows = [(h * 2 + p, f"host{h}", "\n".join(x for i, c in enumerate(common) for x in (f" {c} {h}\t", f"own {h} {p} {i}", "")) + f"\nmenu entry 0 {1 - h}") for h in range(2) for p in range(2)]
    rows += [(9, "host0", None), (10, None, "menu entry 0 0")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    for h in range(2):
        for p in range(2):
            row = got[h * 2 + p]
            rest = "\n".join(x for i in range(n) for x in (f"own {h} {p} {i}", ""))
            assert row["text"] == rest and row["n_dropped"] == n + 1 and row["n_lines"] == 3 * n + 1
    assert got[9]["text"] is None and got[10]["text"] == "menu entry 0 0" and got[10]["n_dropped"] == 0


def test_slots_hold_all_lines_once(spark):
    docs = spark.createDataFrame([(i, "h", "\n".join(f"line {k}" for k in range(1000))) for i in range(2)], "doc_id long, source string, text string")
    found = line_dedup.boilerplate(docs)
    lines, slots = found.select("lines", line_dedup._slots(found["lines"]).alias("slots")).first()
    assert sorted(x for s in slots for x in s) == sorted(lines) and len(lines) == 1000
    assert max(map(len, slots)) < 100 and len(slots) == 32
