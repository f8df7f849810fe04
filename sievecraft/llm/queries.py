"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from sievecraft.llm.decontaminate import OP7_SQL, op7_decontaminate
from sievecraft.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from sievecraft.llm.filter_audit import OP13_SQL, op13_filter_audit
from sievecraft.llm.html_extract import op8_html_extract
from sievecraft.llm.packing import op10_best_fit_packing
from sievecraft.llm.pii import op4_pii
from sievecraft.llm.prefix_trees import OP11_SQL, op11_substring_dedup
from sievecraft.llm.quality import op3_quality_fm
from sievecraft.llm.ranked_search import OP12_SQL, op12_ranked_search
from sievecraft.llm.repeated_spans import op5_suffix_dedup
from sievecraft.llm.simhash import op2_simhash_near_dedup
from sievecraft.llm.url_filter import OP9_SQL, op9_url_filter
from sievecraft.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_fm": op3_quality_fm,
    "op4_pii": op4_pii,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_html_extract": op8_html_extract,
    "op9_url_filter": op9_url_filter,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op7_decontaminate": OP7_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
