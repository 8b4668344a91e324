import heapq
import random

import pyarrow as pa

from filmloom.operators.deliveries import QUOTE_COST, parse_deliveries, parse_lines, plain_text


def cheapest(line, fields):
    """Dijkstra over (place, inside, delimiters)."""
    seen, heap = set(), [(0, 0, 0, 0)]
    while heap:
        cost, i, inside, f = heapq.heappop(heap)
        if (i, inside, f) in seen:
            continue
        seen.add((i, inside, f))
        if i == len(line) and not inside and f == fields - 1:
            return cost
        go = [(cost + QUOTE_COST, i, 1 - inside, f)]
        if not inside and f < fields - 1:
            go.append((cost + 1, i, 0, f + 1))
        if i < len(line):
            ch = line[i]
            if ch == '"':
                go += [(cost, i + 1, 1 - inside, f), (cost + QUOTE_COST, i + 1, inside, f)]
            elif ch == "\t" and not inside:
                go += [(cost + 1, i + 1, 0, f)] + ([(cost, i + 1, 0, f + 1)] if f < fields - 1 else [])
            else:
                go.append((cost, i + 1, inside, f))
        for x in go:
            heapq.heappush(heap, x)


def test_costs_against_search():
    rng = random.Random(5)
    lines = ["".join(rng.choice('ab"\t\té') for _ in range(rng.randrange(14))) for _ in range(400)] + ["", None]
    got = parse_lines(pa.array(lines, pa.string()), 4).to_pylist()
    for line, x in zip(lines, got):
        cost = cheapest(line or "", 4)
        assert (x["quote_edits"], x["delimiter_edits"]) == (cost // QUOTE_COST, cost % QUOTE_COST), line
        if cost == 0:
            assert len(x["fields"]) == 4 and "\t".join(x["fields"]) == line
        else:
            assert x["fields"] is None
            assert sum(w[1:2] == '"' for w in x["edits"].split()) == x["quote_edits"]
            assert len(x["edits"].split()) == x["quote_edits"] + x["delimiter_edits"]


def test_edit_places():
    got = parse_lines(pa.array(['a\t"b\tc', "a\tb", "a\tb\tc\td"]), 3).to_pylist()
    edits = [x["edits"] for x in got]
    assert edits[0] in ('+"@2', '-"@2', '+"@4') and edits[1] in ("+delimiter@1", "+delimiter@0", "+delimiter@3")
    assert edits[2] in ("-delimiter@1", "-delimiter@3", "-delimiter@5")


def test_long_line():
    got = parse_lines(pa.array(["x\t" * 20_000 + '"']), 6).to_pylist()[0]
    assert got["quote_edits"] == 1 and got["delimiter_edits"] == 0 and got["edits"] == "1 quote and 0 delimiter edits"


def test_reasons(spark):
    good = 'tt1\tmovie\t"A\tB"\t 1999 \t\\N\t"Drama"'
    rows = [(1, good), (2, good + '"'), (3, "a\tb"), (4, good.replace("1999", "１９９９")), (5, good.replace("\\N", "0")), (6, None), (7, ""), (8, good.replace("1999", "18500")), (1, good), (9, good.replace("\\N", "0" * 30 + "7")), (10, good.replace("1999", "1999\n"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "raw_id long, line string, fields string")
    out = parse_deliveries(df, "raw_id", "line", 6, [("startyear", 3, 1850, 2100), ("runtimeminutes", 4, 1, 1000)])
    assert sorted((r.row_id, r.reason or "") for r in out.collect()) == sorted(
        [(1, ""), (1, ""), (2, "quoting"), (3, "columns"), (4, "startyear"), (5, "runtimeminutes"), (6, "columns"), (7, "columns"), (8, "startyear"), (9, ""), (10, "startyear")]
    )
    title = out.where("row_id = 1").select(plain_text(out.fields[2]).alias("t"), plain_text(out.fields[4]).alias("n")).first()
    assert tuple(title) == ("A\tB", None)
    assert parse_deliveries(df.limit(0), "raw_id", "line", 6, []).count() == 0


def test_edits_do_not_depend_on_other_lines(spark):
    """Short lines keep their edits beside a wide one, and a wide line has its own."""
    wide = '"' + "x\t" * 5_000 + '"' + "\ta" * 7
    lines = ["a\tb"] * 100 + [wide]
    alone = parse_lines(pa.array(["a\tb"]), 6).to_pylist()[0]["edits"]
    assert [x["edits"] for x in parse_lines(pa.array(lines), 6).to_pylist()] == [alone] * 100 + ["0 quote and 2 delimiter edits"]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "raw_id long, line string")
    got = {r.row_id: (r.reason, r.edits) for r in parse_deliveries(df, "raw_id", "line", 6, []).collect()}
    assert all(got[i] == ("columns", alone) for i in range(100))
    places = {f"-delimiter@{10_002 + 2 * i}" for i in range(7)}
    assert got[100][0] == "columns" and len(got[100][1].split()) == 2 and set(got[100][1].split()) <= places


def test_segments_give_the_same_edits(monkeypatch):
    rng = random.Random(6)
    lines = pa.array(["".join(rng.choice('ab"\t\t') for _ in range(rng.randrange(60))) for _ in range(300)])
    whole = parse_lines(lines, 4).to_pylist()
    monkeypatch.setattr("filmloom.operators.deliveries.SEGMENT", 3)
    assert parse_lines(lines, 4).to_pylist() == whole
