"""Names of the library's queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import oracle
from larkspur.plans import queries as q

_NAMES = (
    "tokenize_original tokenize_nostop tokenize_stemmed stem_terms token_ngrams postings_tf_positions index_blocks doc_lengths doc_lengths_distinct corpus_stats length_facet approx_vocab approx_vocab_within index_catalog "
    "term_stats_df_ttf_tlen term_lookup term_vector query_terms rank_okapi rank_tfidf rank_bm25 rank_laplace rank_jm rank_bm25_original rank_bm25_stems_only rank_bm25_stemmed min_window rank_proximity borda_fusion free_text_search legacy_query_terms trec_run_text "
    "qrels_agg eval_prec_recall_at_k eval_f1 eval_avg_precision eval_rprec eval_interp11 eval_ndcg eval_summary trec_eval_report judged_total pr_curve page_links page_text html_pages canonical_links link_edges inlinks inlink_lists "
    "outdegree sink_pages pagerank_k pagerank hits_base_set hits_k hits frontier_order merge_insert_if_absent robots_filter seed_hosts mail_clean mail_labels_joined bigram_match "
    "ngram_feature_matrix sparse_matrix term_ids sparse_matrix_split ltr_feature_matrix ltr_regression train_test_split spam_tree spam_tree_top top_weights accuracy_confusion accuracy_by_split top_n_by_value stop_words "
    "collection_text topics_text run_text qrels_text adjacency_text scores_text words_text root_set_text mail_labels_text arff_text libsvm_text"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(q, n) for n in _NAMES}
SQL: dict[str, str] = dict(oracle.SQL)
