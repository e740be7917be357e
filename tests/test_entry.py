import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLAIN = ["cosine_topk", "hamming_topk", "top_pairs", "average_precision", "centroids", "read_images", "average_hash", "hash_neighbours", "range_search", "map_intervals", "stream_topk", "image_tiles", "word_topk"]


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_its_sql(spark, name):
    found = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()[list(found.columns)]
    order = list(found.columns)
    found, want = (df.sort_values(order).reset_index(drop=True) for df in (found, want))
    assert len(found) == len(want) and all((abs(found[c] - want[c]) < 1e-9).all() if found[c].dtype.kind == "f" else (found[c] == want[c]).all() for c in order)


def test_the_rest_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['galleon.llm'] = None; import __spark_entry__ as e; assert 'cosine_topk' in e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
