"""The queries of this subpackage, by name, and their SQL forms."""

from casewise.llm.centroids import OP12_SQL, op12_va_file_clusters
from casewise.llm.chat_format import OP10_SQL, op10_chat_format
from casewise.llm.decontaminate import OP4_SQL, op4_decontaminate
from casewise.llm.dedup import op1_bagminhash_dedup
from casewise.llm.language import op6_language_id
from casewise.llm.licenses import op9_license_scan
from casewise.llm.nearest import OP5_SQL, op5_vantage_points
from casewise.llm.packing import op7_mixture_packing
from casewise.llm.phrases import OP13_SQL, op13_suffix_collocations
from casewise.llm.pii import op3_information_pii
from casewise.llm.shard import op8_shard
from casewise.llm.token_counts import op11_prefix_token_counts
from casewise.llm.url_filter import OP2_SQL, op2_url_redirects

QUERIES = {
    "op1_bagminhash_dedup": op1_bagminhash_dedup,
    "op2_url_redirects": op2_url_redirects,
    "op3_information_pii": op3_information_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_vantage_points": op5_vantage_points,
    "op6_language_id": op6_language_id,
    "op7_mixture_packing": op7_mixture_packing,
    "op8_shard": op8_shard,
    "op9_license_scan": op9_license_scan,
    "op10_chat_format": op10_chat_format,
    "op11_prefix_token_counts": op11_prefix_token_counts,
    "op12_va_file_clusters": op12_va_file_clusters,
    "op13_suffix_collocations": op13_suffix_collocations,
}

ORACLE_SQL = {
    "op2_url_redirects": OP2_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_vantage_points": OP5_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_va_file_clusters": OP12_SQL,
    "op13_suffix_collocations": OP13_SQL,
}
