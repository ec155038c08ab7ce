"""The pipeline against a plain version, stage by stage."""

import random
import shutil
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline as C
from loomgrid.llm import decontam, packing, pii, quality
from test_simhash import brute, copies

FOLDER = "/root/testdata/sf0.001"


def plain(folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    rows = con.execute(quality.sql(columns="doc_id, text")).fetchall()
    _, group = brute(rows)
    rows = [(d, t) for d, t in rows if group.get(d, d) == d]
    items = con.execute(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()

    def covered(t):
        w = decontam.words(t)
        for _, x in items:
            x = decontam.words(x)
            grams = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
            if len({k + j for k in range(len(x) - 3) if tuple(x[k : k + 4]) in grams for j in range(4)}) >= 0.5 * len(x):
                ids = {}
                if sum(k for _, _, k in decontam.tiles([ids.setdefault(y, len(ids)) for y in x], [ids.get(y, -1) for y in w])) >= 0.5 * len(x):
                    return True
        return False

    finder = pii.Finder()
    return {d: pii.mask(t, finder) for d, t in rows if not covered(t)}


def test_run_against_the_plain_version(spark):
    want = plain(FOLDER)
    got = C.run(spark, FOLDER).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.tokens
        assert r.bin_offset + r.tokens <= r.capacity and r.capacity in packing.CAPACITIES
    near = set(want) ^ set(lengths)
    assert len(near) <= 2, near  # the search finds at least nine of ten pairs
    assert all(lengths[d] == len(want[d].split()) + 1 for d in want if d in lengths)


def test_stages(spark, awkward, nothing):
    assert [f.__name__ for _, f in C.STAGES] == ["quality_rules", "near_dedup", "decontamination", "private_data", "best_fit_packing"]
    for docs in (awkward, nothing):
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == awkward.columns
        C.STAGES[-1][1](spark, docs, FOLDER).count()


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = []
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        sizes.append(docs.count())
    assert 200 > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    masked = docs.filter("text like '%<EMAIL>%'")
    assert masked.count() > 0 and np.all([r.n_chars == len(r.text) for r in masked.collect()])


def test_no_near_copy_is_left(spark, tmp_path):
    """Of documents and copies with one word in eight exchanged, just those of the plain version are packed."""
    docs, r = pq.read_table(f"{FOLDER}/documents.parquet"), random.Random(1)
    texts, copies = docs.column("text").to_pylist(), []
    for t in texts:
        w, other = (t or "").split(), (r.choice(texts) or "").split() or ["x"]
        at = set(r.sample(range(len(w)), len(w) // 8))
        copies.append(" ".join(r.choice(other) if k in at else x for k, x in enumerate(w)))
    new = {"doc_id": [10**6 + d for d in docs.column("doc_id").to_pylist()], "text": copies, "n_chars": list(map(len, copies))}
    more = pa.table([pa.array(new[f.name], f.type) if f.name in new else docs.column(f.name) for f in docs.schema], schema=docs.schema)
    pq.write_table(pa.concat_tables([docs, more]), tmp_path / "documents.parquet")
    shutil.copy(f"{FOLDER}/benchmark.parquet", tmp_path)
    want, got = plain(tmp_path), {x.doc_id for x in C.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == set(want) and 10 < sum(d >= 10**6 for d in got) < len(texts)


def test_rows_without_id_leave_no_near_copy(spark):
    """A row of null id goes when another is near: documents with an id stay first, of rows without one just one."""
    made = copies(60, 7)
    rows = [(k if k % 3 else 10**6 + k, t) for k, t in made]  # from 10**6 on: without an id
    _, group = brute(rows)
    df = spark.createDataFrame([(d if d < 10**6 else None, t) for d, t in rows] + [(None, t) for _, t in made[:9]] + [(None, ""), (None, None), (7, "")], "doc_id long, text string")
    kept, of = C.near_dedup(spark, df, FOLDER).collect(), {t: group[d] for d, t in rows}
    assert sorted(of[r.text] for r in kept if r.text) == sorted(set(group.values()))
    assert {r.doc_id for r in kept if r.doc_id is not None} == {g for g in group.values() if g < 10**6} | {7}
    assert any(r.doc_id is None and r.text for r in kept) and sum(not r.text for r in kept) == 3


def test_copies_without_id_are_not_packed(spark, tmp_path):
    docs = pq.read_table(f"{FOLDER}/documents.parquet")
    more = docs.set_column(docs.schema.get_field_index("doc_id"), "doc_id", pa.nulls(len(docs), docs.schema.field("doc_id").type))
    pq.write_table(pa.concat_tables([docs, more]), tmp_path / "documents.parquet")
    shutil.copy(f"{FOLDER}/benchmark.parquet", tmp_path)
    assert {x.doc_id for x in C.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(plain(FOLDER))
