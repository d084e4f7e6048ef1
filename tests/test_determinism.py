"""The same rows whatever the number of partitions, and plans that stay in the JVM where they should."""

import pytest
from tests.conftest import rows_of

from docloom import plans

SOME = ["newest_wins", "page_labels", "code_ranges", "gaps_islands", "overlay_merge", "css_cascade_argmax", "redact_spans", "pen_positions", "natural_sort", "fill_forms", "capped_list"]


@pytest.mark.parametrize("name", SOME)
def test_partitions(spark, sf_dir, name):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = plans.QUERIES[name](spark, sf_dir)
            found.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]


#: Modules whose queries write and read files, in Python, but for the two that don't.
FILES = {n for n, q in plans.QUERIES.items() if q.__module__.rsplit(".", 1)[-1] in ("archive_queries", "codec_queries", "content_queries", "pdf_queries")} - {"permissions", "checksums"}
PYTHON = set("""
html_elements css_cascade pdf_text_round_trip pdf_documents ebook_text archive_inventory postscript_calculator sampled_function form_scripts layout_conservation
flex_sizes justified column_widths table_cells collapsed_borders float_places line_breaks books_as_pages book_outlines fixed_as_pages comics_as_pages book_links
font_programs built_files anonymous_cells face_requests property_census path_syntax object_values recalculated_forms broken_blocks any_texts
""".split())
NATIVE = sorted(set(plans.QUERIES) - FILES - PYTHON)


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_native_plans(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct"))


@pytest.mark.parametrize(("name", "columns"), [("newest_wins", {"event_id", "ts", "user_id", "event_type", "value"}), ("pdf_dates", {"o_orderkey", "o_orderdate"}), ("html_links", {"page_id", "html"}), ("rotate_normalize", {"l_orderkey", "l_linenumber", "l_quantity"})])
def test_scans_read_only_what_they_need(spark, sf_dir, name, columns):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} == columns
