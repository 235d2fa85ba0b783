import os
import tempfile

from cadenza.sources.songs import read_songs_csv
from cadenza.sources import store

CSV = 'a,b,c\n1,x,hello\n2,y,too,many\n3,z\n4,NA,None\n\n5,"q\nr",null\n6,"he said ""hi""",ok\n'


def _csv():
    d = tempfile.mkdtemp(prefix="cadenza-csv-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as fh:
        fh.write(CSV)
    return p


def test_csv_permissive_matches_reference_reader(spark):
    df = read_songs_csv(spark, _csv(), columns=("a", "b", "c"), id_col="a")
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [
        (1, "1", "x", "hello"),
        (2, "2", "y", "too"),
        (3, "3", "z", None),
        (4, "4", None, None),
        (5, "5", "q\nr", None),
        (6, "6", 'he said "hi"', "ok"),
    ]


def test_csv_dropmalformed_loses_rows(spark):
    df = read_songs_csv(spark, _csv(), columns=("a", "b", "c"), id_col="a", mode="DROPMALFORMED")
    assert sorted(r["song_id"] for r in df.collect()) == [1, 4, 5, 6]


def test_run_store_roundtrip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cadenza-store-"), "runs")
    a = spark.createDataFrame([(1, 0), (2, 1)], "song_id bigint, cluster int")
    store.append_run(a, path, "r1")
    store.append_run(a.limit(1), path, "r2")
    assert store.read_run(spark, path, "r1").count() == 2
    assert store.read_run(spark, path, "r2").count() == 1


def test_csv_repeated_rows_keep_ids_of_their_own(spark, tmp_path):
    from cadenza.operators.sample import sample_exact

    text = "artist_name,song_title,corpus,song_url\n" + "".join(f'a{i},t,"line\nof {i}",u\n' for i in range(10)) * 3
    (tmp_path / "f.csv").write_text(text)
    df = read_songs_csv(spark, str(tmp_path))
    assert df.count() == 30 == df.select("song_id").distinct().count()
    assert df.join(df.select("song_id"), "song_id").count() == 30
    assert sample_exact(df, 10).count() == 10
    again = read_songs_csv(spark, str(tmp_path)).repartition(5)
    assert {r[0] for r in again.select("song_id").collect()} == {r[0] for r in df.select("song_id").collect()}


def test_csv_round_trip(spark, tmp_path):
    from cadenza.sources.songs import write_songs_csv

    rows = [(1, "a", " t ", 'he said "hi"\n, twice ', "u"), (2, None, "x,y", "", "u"), (3, "a", " t ", 'he said "hi"\n, twice ', "u")]
    df = spark.createDataFrame(rows, "song_id bigint, artist_name string, song_title string, corpus string, song_url string")
    write_songs_csv(df, str(tmp_path / "out"))
    back = sorted(tuple(r) for r in read_songs_csv(spark, str(tmp_path / "out"), id_col="song_id").collect())
    assert back == [(1, "a", " t ", 'he said "hi"\n, twice ', "u"), (2, None, "x,y", None, "u"), rows[2]]


def test_songs_in_order(spark):
    from cadenza.operators.clusters import songs_in_order

    df = spark.createDataFrame([(i, i % 3, None if i == 4 else f"t{i}", None, None) for i in range(40)],
                               "song_id bigint, cluster int, song_title string, artist_name string, song_url string")
    got = sorted((r["cluster"], r["pos"], r["song_id"]) for r in songs_in_order(df.repartition(4)).collect())
    assert got == [(c, i + 1, c + 3 * i) for c in range(3) for i in range(len(range(c, 40, 3)))]
    named = {r["song_id"]: r for r in songs_in_order(df).collect()}
    assert named[4]["song_title"] == "Unknown" == named[0]["artist_name"] and named[0]["song_url"] == ""


def test_intermediate_tables_lie_in_the_runs_folder_and_can_be_cleared(spark):
    import os

    from cadenza.session import checkpoint_dir, clear_intermediate, shared_folder

    folder = checkpoint_dir(spark)
    assert folder.startswith(shared_folder(spark)) and spark.sparkContext.applicationId in folder
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/some-table")
    local = folder.removeprefix("file:")
    assert os.path.exists(f"{local}/some-table")
    assert clear_intermediate(spark) and not os.path.exists(local) and not clear_intermediate(spark)
