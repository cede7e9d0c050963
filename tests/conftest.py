import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from yieldengine.schema import ORDER, SEQ  # noqa: E402
from yieldengine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", partitions=4)
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


LEDGER = (
    f"{ORDER} string, MATERIAL string, MATERIALSPECIE string, TALLYGRADE string, PLANT string, "
    "MATERIALTHICKNESS double, TALLYLENGTH double, TALLYWIDTH double, {volume} double, IS_DELETED boolean"
)


@pytest.fixture
def ledger(spark):
    """ledger("BFIN", rows): rows of (order, material, specie, grade, plant, t, l, w, volume, deleted)."""
    from pyspark.sql import functions as F

    def make(volume, rows):
        numbered = [(*row, i) for i, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, LEDGER.format(volume=volume) + ", n bigint")
        return df.withColumn(SEQ, F.struct("n")).drop("n")

    return make


HISTORY = (
    f"{ORDER} string, Input_Material string, Input_Plant string, Input_Grade string, Output_Material string, "
    "Output_Grade string, Total_Input_BF double, Total_Output_BF double"
)


@pytest.fixture
def history(spark):
    from yieldengine.operators.volume import with_yield

    return lambda rows: with_yield(spark.createDataFrame(rows, HISTORY))


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}
