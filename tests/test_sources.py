import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.sql import types as T

from cohortloom.catalog import Catalog, Feature, Instrument
from cohortloom.cohort import Cohort, read_and_join
from cohortloom.session import ship_package
from cohortloom.sources.release import convert_release, instrument_path, read_csv, read_id_list, release_date
from cohortloom.sources.store import cache_path, checkpointed, ensure_checkpoint_dir, materialize

CATALOG = Catalog([Instrument("a", "a", None, None, "score", r"q\d{2}_"), Instrument("m", "sub/m")], "id")


@pytest.fixture()
def release(tmp_path):
    root = tmp_path / "data_release_2024-03-01"
    (root / "sub").mkdir(parents=True)
    (root / "a-2024-03-01.csv").write_text("id,q01_x,q02_y,asd,sex,score\ns1,1,0.5,true,Male,10\ns2,,NA,false,None,\ns3,3,2,true,-,7\n")
    (root / "sub" / "m-2024-03-01.csv").write_text("id,code\ns1,01\ns4,x\n")
    return str(root)


def test_paths():
    assert release_date("/x/data_release_2024-03-01/") == "2024-03-01"
    assert instrument_path("/x/r_2024", "sub/m") == "/x/r_2024/sub/m-2024.csv"


def test_csv_types_and_missing_texts(spark, release):
    c = Cohort.read(spark, release, CATALOG)
    a = c.tables["A"]
    assert [f.dataType.simpleString() for f in a.schema.fields] == ["string", "bigint", "double", "boolean", "string", "bigint"]
    assert {tuple(r) for r in a.collect()} == {
        ("s1", 1, 0.5, True, "Male", 10), ("s2", None, None, False, None, None), ("s3", 3, 2.0, True, "-", 7)
    }
    assert c.instrument("A").questions == ("q01_x", "q02_y")
    assert c.tables["M"].schema["code"].dataType == T.StringType()


def test_schema_is_respected(spark, release):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    c = Cohort.read(spark, release, CATALOG, ["a"], {"A": schema})
    assert c.tables["A"].dtypes == [("id", "string"), ("score", "double")]
    with pytest.raises(ValueError, match="lacks columns"):
        Cohort.read(spark, release, CATALOG, ["a"], {"A": T.StructType([T.StructField("zz", T.StringType())])})


def test_read_and_join_reads_needed_instruments(spark, release):
    cohort, df, instruments = read_and_join(spark, release, CATALOG, [Feature("M", "code"), Feature("A", "score")])
    assert [i.code for i in instruments] == ["M", "A"] and set(cohort.tables) == {"M", "A"}
    assert {tuple(r) for r in df.collect()} == {("s1", "01", 10), ("s4", "x", None), ("s2", None, None), ("s3", None, 7)}


def test_convert_release(spark, release, tmp_path):
    target = str(tmp_path / "parquet_2024-03-01")
    convert_release(spark, release, target, CATALOG)
    again = Cohort.read(spark, target, CATALOG, fmt="parquet")
    assert again.tables["A"].count() == 3 and again.tables["M"].count() == 2


def test_id_list(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("  s1 \n\ns2\ns1\n   \n")
    assert sorted(r["id"] for r in read_id_list(spark, str(path), "id").collect()) == ["s1", "s2"]


def test_materialize_computes_once_and_keys_by_parameters(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    root = str(tmp_path / "cache")
    for _ in range(2):
        assert materialize(spark, build, root, "x", {"k": 1}).count() == 3
    assert len(calls) == 1
    materialize(spark, build, root, "x", {"k": 2})
    assert len(calls) == 2 and cache_path(root, "x", {"k": 1}) != cache_path(root, "x", {"k": 2})


def test_unfinished_write_is_rebuilt(spark, tmp_path):
    root = str(tmp_path / "cache")
    path = cache_path(root, "x", {})
    spark.range(5).write.parquet(path)
    (tmp_path / "cache" / "x" / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert materialize(spark, lambda: spark.range(2), root, "x", {}).count() == 2


def test_checkpoint_uses_the_session_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder and spark.sparkContext.getCheckpointDir().startswith(("file:" + folder, folder))
    assert checkpointed(spark.range(4)).count() == 4


def test_csv_quotes_and_types(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text(
        'id,txt,n,yn,d,b,e\nA,"say ""hi"", ok",3,y,1d,true,1e3\nB,"two\nlines",4,n,2f,False,-.5\nC,plain,,y,1d,TRUE,2\n'
    )
    df = read_csv(spark, str(path), "id", multi_line=True)
    assert dict(df.dtypes) == {"id": "string", "txt": "string", "n": "bigint", "yn": "string", "d": "string", "b": "boolean", "e": "double"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows["A"]["txt"] == 'say "hi", ok' and rows["A"]["n"] == 3 and rows["B"]["txt"] == "two\nlines" and rows["C"]["n"] is None
    assert rows["B"]["e"] == -0.5 and rows["B"]["b"] is False
    schema = "id string, n int, txt string"
    from pyspark.sql.types import StructType

    assert [r["n"] for r in read_csv(spark, str(path), "id", StructType.fromDDL(schema), multi_line=True).orderBy("id").collect()] == [3, 4, None]


def test_package_is_shipped_once_from_many_threads():
    """A cluster refuses a second file of the same name under another path."""
    sent = []

    def add(path):
        time.sleep(0.05)
        sent.append(path)

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app-of-threads", addPyFile=add))
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(ship_package, [session] * 4))
    assert len(sent) == 1


def test_shuffles_behind_a_checkpoint_leave_the_disk(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    rows = spark.range(1000).repartition(5, "id").groupBy("id").count()
    before, kept = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = checkpointed(rows)
    assert not held() - before
    assert (found.count(), rows.count()) == (1000, 1000)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept
