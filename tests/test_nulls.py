"""Every registered query with SQL on tables that have nulls in every column but their ids."""

from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom.operators import catalogue
from tests.test_parity import DATA, NAMES, rows

#: Columns that name a row or another table's row.
IDS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


@pytest.fixture(scope="module")
def holes(tmp_path_factory):
    """The smallest tables, every seventh value of each column gone, another seventh for each column; of the long ones a part."""
    to = tmp_path_factory.mktemp("holes")
    for p in DATA.glob("*.parquet"):
        t = pq.read_table(p).slice(0, 400)
        for k, name in enumerate(t.column_names):
            if name not in IDS[p.stem]:
                values = [None if (i + 3 * k) % 7 == 2 else v for i, v in enumerate(t.column(name).to_pylist())]
                t = t.set_column(k, name, pa.array(values, t.schema.field(name).type))
        pq.write_table(t, to / p.name)
    return to


@pytest.fixture(scope="module")
def db(holes):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(holes).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_with_nulls(spark, db, holes, name):
    df = catalogue.queries()[name](spark, str(holes))
    got = rows([tuple(r) for r in df.collect()], df.columns)
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert got == rows(found.fetchall(), columns)
