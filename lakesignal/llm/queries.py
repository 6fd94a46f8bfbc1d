"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .collocations import OP12_SQL, op12_collocations
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_text import op10_html_text
from .knn_join import OP3_SQL, op3_knn_join
from .learned_ann import op11_learned_ann
from .license_scan import op2_license_scan
from .near_dup import OP8_SQL, op8_near_dup
from .packing import op4_packing
from .quality_cnn import op9_quality_cnn
from .quality_rules import op1_quality_rules
from .url_filter import OP7_SQL, op7_url_filter
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_knn_join": op3_knn_join,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_near_dup": op8_near_dup,
    "op9_quality_cnn": op9_quality_cnn,
    "op10_html_text": op10_html_text,
    "op11_learned_ann": op11_learned_ann,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}
SQL = {
    "op3_knn_join": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_near_dup": OP8_SQL,
    "op12_collocations": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
