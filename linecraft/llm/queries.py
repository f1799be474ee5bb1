"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from linecraft.llm.chat_format import op1_chat_format
from linecraft.llm.decontaminate import op9_decontamination
from linecraft.llm.doc_fingerprint import op3_doc_fingerprint
from linecraft.llm.filter_audit import OP13_SQL, op13_filter_audit
from linecraft.llm.html_text import op4_html_extraction
from linecraft.llm.language_id import op11_language_id
from linecraft.llm.license_scan import op2_license_scan
from linecraft.llm.line_dedup import op8_line_dedup
from linecraft.llm.lm_score import op7_lm_score
from linecraft.llm.mask_search import OP12_SQL, op12_ranked_search
from linecraft.llm.mixing import OP5_SQL, op5_mixing
from linecraft.llm.quality import op10_quality_classifier
from linecraft.llm.simhash_dedup import op6_simhash_dedup
from linecraft.session import ship_package


def _shipped(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir.rstrip("/"))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_chat_format, op2_license_scan, op3_doc_fingerprint, op4_html_extraction, op5_mixing,
    op6_simhash_dedup, op7_lm_score, op8_line_dedup, op9_decontamination, op10_quality_classifier,
    op11_language_id, op12_ranked_search, op13_filter_audit)}

ORACLE = {"op5_mixing": OP5_SQL.strip(), "op12_ranked_search": OP12_SQL.strip(),
          "op13_filter_audit": OP13_SQL.strip()}
