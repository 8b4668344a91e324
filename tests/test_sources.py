import gzip
import urllib.error

import pytest

from filmloom.sources.delimited import fetch, ingest, read_tsv, table_name
from filmloom.streaming.deliveries import line_stream, route_deliveries

BASICS = [
    "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres",
    'tt1\tmovie\t"Quoted, start\tx\t0\t1999\t\\N\t100\tDrama,Action',
    "tt2\tmovie\tNo year\tx\t0\t\\N\t\\N\t100\tDrama",
    "tt3\tshort\tShort\tx\t0\t2000\t\\N\t10\tDrama",
    "tt4\tmovie\tBad number\tx\t0\tabc\t\\N\t90\tDrama",
    "tt5\tmovie\tPlain\tx\t0\t2001\t\\N\t90\t\\N",
    "tt6\tmovie\tPlain\tx\t0\t2001\t\\N\t90\tDrama",
]
OTHERS = {
    "title.ratings": ["tconst\taverageRating\tnumVotes", "tt1\t7.5\t10", "tt3\t5.0\t1", "tt6\t\\N\t2"],
    "title.principals": ["tconst\tordering\tnconst\tcategory\tjob\tcharacters", 'tt1\t1\tnm1\tactor\t\\N\t["A"]', "tt1\t2\tnm2\twriter\t\\N\t\\N", "tt3\t1\tnm3\tactor\t\\N\t\\N", "tt6\t1\tnm4\tdirector\t\\N\t\\N"],
    "name.basics": ["nconst\tprimaryName\tbirthYear", "nm1\tAnn\t1950", "nm2\tBo\t\\N", "nm3\tCy\t\\N", "nm4\t\\N\t\\N"],
}


def deliver(folder, basics=BASICS):
    folder.mkdir(exist_ok=True)
    for name, lines in {"title.basics": basics, **OTHERS}.items():
        with gzip.open(folder / f"{name}.tsv.gz", "wt") as file:
            file.write("\n".join(lines) + "\n")
    return str(folder)


def test_read(spark, tmp_path):
    rows = {r["tconst"]: r for r in read_tsv(spark, f"{deliver(tmp_path)}/title.basics.tsv.gz", "title.basics", 3).collect()}
    assert rows["tt1"]["primaryTitle"] == '"Quoted, start' and rows["tt1"]["startYear"] == 1999 and rows["tt2"]["startYear"] is None
    assert rows["tt4"]["startYear"] is None and rows["tt5"]["genres"] is None and len(rows) == 6
    assert read_tsv(spark, f"{tmp_path}/title.basics.tsv.gz", "title.basics").columns == ["tconst", "titleType", "primaryTitle", "startYear", "runtimeMinutes", "genres"]


def test_ingest(spark, tmp_path):
    source = deliver(tmp_path / "in")
    counts = ingest(spark, source, f"{tmp_path}/out")
    assert counts == {"title_basics": 2, "title_ratings": 2, "title_principals": 2, "name_basics": 2}
    assert counts == ingest(spark, source, f"{tmp_path}/out", 4)
    assert {r["nconst"] for r in spark.read.parquet(f"{tmp_path}/out/name_basics.parquet").collect()} == {"nm1", "nm4"}
    deliver(tmp_path / "in", [*BASICS, BASICS[1]])
    with pytest.raises(ValueError):
        ingest(spark, source, f"{tmp_path}/out")


def test_fetch(tmp_path):
    (tmp_path / "remote").mkdir()
    deliver(tmp_path / "remote")
    url = f"file://{tmp_path}/remote"
    path = fetch(url, f"{tmp_path}/local", "title.ratings")
    before = open(path, "rb").read()
    (tmp_path / "remote" / "title.ratings.tsv.gz").write_bytes(b"new")
    assert fetch(url, f"{tmp_path}/local", "title.ratings") == path and open(path, "rb").read() == before
    with pytest.raises(urllib.error.URLError):
        fetch(url, f"{tmp_path}/local", "title.none")
    assert table_name("title.basics") == "title_basics"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sound, broken = 'tt1\tmovie\tA\t1999\t100\tDrama', 'tt2\tmovie\t"A\t1999\t100\tDrama'
    (tmp_path / "in" / "a.tsv").write_text(f"{sound}\n{broken}\n")
    checks = [("startyear", 3, 1850, 2100)]

    def step():
        q = route_deliveries(line_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", 6, checks)
        q.awaitTermination(60)
        assert q.exception() is None
        return tuple(spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in ("valid", "rejected"))

    assert step() == (1, 1) and step() == (1, 1)
    (tmp_path / "in" / "b.tsv").write_text(f"{sound}\nshort line\n")
    assert step() == (2, 2)
    assert {r["reason"] for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()} == {"quoting", "columns"}
