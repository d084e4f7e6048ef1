import ast
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from tests.llm import brute
from tests.llm.test_mixing import targets
from tests.llm.test_sketches import components

from docloom.llm import queries


def test_stages(spark, sf_dir):
    """Each stage on all that the one before kept, against plain versions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "decontamination", "source_mixing", "token_output"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(before, docs.schema), sf_dir)
        rows = out.collect()
        if name != "token_output":
            assert out.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "quality_classifier":
            scores = {r.doc_id: r.predicted for r in queries.op4_quality_classifier(spark, sf_dir).collect()}
            assert ids == {d for d, p in scores.items() if p}
            assert sum(quality[r.doc_id] == 1 for r in rows if r.doc_id in quality) >= 0.97 * sum(1 for r in rows if r.doc_id in quality)
        elif name == "simhash_dedup":
            # Five words and a similarity of 0.8: the rule for stages on word shingles.
            texts = sorted((r.doc_id, r.text) for r in before)
            root = components([t for _, t in texts])
            assert ids == {texts[i][0] for i in root.values()}
        elif name == "decontamination":
            assert ids == {r.doc_id for r in before if not any(i.text in r.text for i in items)}
        elif name == "source_mixing":
            size = lambda r: len(brute.WORD.findall(r.text))
            total, taken, sums = Counter(), Counter(), {}
            for r in before:
                total[r.source] += size(r)
                sums[r.source] = {a + b for a in sums.get(r.source, {0}) for b in (0, size(r))}
            for r in rows:
                taken[r.source] += size(r)
            want = targets(dict(total))
            for s, whole in total.items():  # a few documents don't add up to every number: as near as they can come
                rest = want[s] % whole if want[s] < 2 * whole else 0
                best = min(abs(a - rest) for a in sums[s])
                assert abs(taken[s] - want[s]) <= best + 0.005 * want[s] + 1
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
        else:
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before)
            rows.sort(key=lambda r: r.start)
            assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        before = rows


def test_run(spark, sf_dir):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert a == b and a


ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("path", sorted(str(p.relative_to(ROOT)) for p in (ROOT / "docloom").rglob("*.py") if "llm" not in p.parts))
def test_nothing_else_imports_the_subpackage(path):
    for node in ast.walk(ast.parse((ROOT / path).read_text())):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        assert not any(n.startswith(("docloom.llm", "corpus_pipeline")) for n in names)
