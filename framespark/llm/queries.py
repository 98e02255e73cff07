"""Queries of the corpus operators and the SQL that gives the same rows."""

from .clustering import OP12_SQL, op12_clustering
from .decontaminate import op10_decontamination
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .jaccard_join import op11_jaccard_join
from .mixing import OP2_SQL, op2_mixing
from .near_dedup import op9_near_dedup
from .phrases import OP13_SQL, op13_phrases
from .secret_scan import op3_secret_scan
from .sharding import op8_sharding
from .token_counts import op5_token_counts
from .token_files import op6_token_files
from .toxicity import op4_toxicity
from .url_filter import OP1_SQL, op1_url_filter

_OPERATORS = (op1_url_filter, op2_mixing, op3_secret_scan, op4_toxicity, op5_token_counts, op6_token_files, op7_exact_dedup, op8_sharding, op9_near_dedup, op10_decontamination, op11_jaccard_join, op12_clustering, op13_phrases)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op2_mixing": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op12_clustering": OP12_SQL, "op13_phrases": OP13_SQL}
