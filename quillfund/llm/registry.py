"""Queries of this subpackage and their SQL, for the driver's entry module."""

import corpus_pipeline
from quillfund.llm.collision_counting import OP2_SQL, op2_collision_counting
from quillfund.llm.collocations import OP13_SQL, op13_collocations
from quillfund.llm.filter_audit import OP12_SQL, op12_filter_audit
from quillfund.llm.line_crf import op8_line_crf
from quillfund.llm.mixture import op11_mixture
from quillfund.llm.pieces import op9_prefix_table
from quillfund.llm.simhash import op3_simhash
from quillfund.llm.spaced_seeds import op10_spaced_seeds
from quillfund.llm.suffix_buckets import OP6_SQL, op6_suffix_buckets
from quillfund.llm.suffix_trees import OP4_SQL, op4_suffix_trees
from quillfund.llm.surrogates import op1_surrogates
from quillfund.llm.warc import OP7_SQL, op7_warc_revisits
from quillfund.llm.weak_toxicity import op5_weak_toxicity

QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_collision_counting": op2_collision_counting,
    "op3_simhash": op3_simhash,
    "op4_suffix_trees": op4_suffix_trees,
    "op5_weak_toxicity": op5_weak_toxicity,
    "op6_suffix_buckets": op6_suffix_buckets,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_line_crf": op8_line_crf,
    "op9_prefix_table": op9_prefix_table,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_mixture": op11_mixture,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op2_collision_counting": OP2_SQL, "op4_suffix_trees": OP4_SQL, "op6_suffix_buckets": OP6_SQL, "op7_warc_revisits": OP7_SQL, "op12_filter_audit": OP12_SQL, "op13_collocations": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
