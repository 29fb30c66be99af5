"""Queries that make or read documents do so once, in one task, and send no words to another."""

import pytest

import __spark_entry__ as e

#: Python steps and joins or groupings by shuffle of a query's plan.
PLANS = {
    "bbox_layout": (1, 0),
    "encrypted_aes": (1, 0),
    "encrypted_rc4": (1, 0),
    "link_words": (1, 0),
    "page_text": (1, 0),
    "physical_layout_text": (1, 0),
    "reading_order_text": (1, 0),
    "search_ignore_diacritics": (1, 2),
    "word_tsv": (1, 0),
    "xml_pages": (1, 0),
    "bbox_xhtml": (1, 0),
    "dehyphenate_all": (1, 0),
    "form_reset": (1, 0),
    "attach_detach": (1, 0),
    "label_to_index": (1, 1),
    "annotation_edit": (1, 0),
    "form_fill": (1, 0),
    "link_targets": (1, 0),
    "merge_docs": (3, 1),
    "url_list": (1, 0),
    "marked_lines": (1, 0),
    "split_pages": (2, 1),
    "font_list": (1, 0),
    "form_fields": (1, 0),
    "dehyphenate_soft": (1, 0),
    "raw_text": (1, 0),
    "font_differences": (1, 0),
    "search_across_lines": (1, 2),
    "label_interval_lengths": (1, 0),
    "font_macromanencoding": (1, 0),
}


@pytest.mark.parametrize("name", PLANS)
def test_documents_are_made_and_read_once(spark, name):
    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("hashpartitioning")) == PLANS[name]
