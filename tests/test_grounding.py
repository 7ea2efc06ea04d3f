"""The SQL of the grounding checks states their rules on texts that are rare in the tables."""

import duckdb
import pytest

from larkspur.plans import registry

RULED = {14: "llm and more of it", 28: "at [company] now", 56: "zero​width", 98: "", 112: None, 182: "lorem ipsum dolor", 196: "SQL", 224: "plain words here"}


@pytest.mark.parametrize("name", ["g2_claims", "g2_rejection"])
def test_rare_reasons(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's', 0)", [*RULED.items(), (1, None), (2, None), (3, "x")])
    con.execute("CREATE TABLE benchmark AS SELECT i AS item_id, 'the quoted words of item ' || i AS text FROM range(5) r(i)")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
    assert {"unsupported term", "placeholder", "hidden character", "empty"} <= {r[1] for r in found}
