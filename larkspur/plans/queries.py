"""The library's operators applied to the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.stem import stem_dictionary
from larkspur.functions.text import MODELS, STOP_WORDS, legacy_query_tokens, ngrams, raw_tokens, tokens
from larkspur.functions.urls import host_key
from larkspur.operators import evaluate as ev
from larkspur.operators import graph, index, learn, mail, ranking, runs, web
from larkspur.session import cut, scratch_path, table
from larkspur.sources import files
from larkspur.sources.files import labelled_files

SCORES = ("okapi_score", "tfidf_score", "bm25_score", "laplace_score", "mercer_score")
LOOKED_UP = ["patrol", "inspector", "u.s"]
BIGRAM = ("told", "reporters")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _index(spark: SparkSession, d: str, model: str = "no_stopwords") -> index.Index:
    return index.index_of(_documents(spark, d), d, model)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return ranking.query_terms(table(spark, d, "topics"))


# -- text and index


def tokenize_original(spark: SparkSession, d: str) -> DataFrame:
    return index.positions(_documents(spark, d), "doc_id", "text", "original")


def tokenize_nostop(spark: SparkSession, d: str) -> DataFrame:
    return index.positions(_documents(spark, d), "doc_id", "text", "no_stopwords")


def tokenize_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return index.positions(_documents(spark, d), "doc_id", "text", "no_stopwords_stemmed")


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    return stem_dictionary(index.positions(_documents(spark, d), "doc_id", "text", "original"))


def token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    grams = _documents(spark, d).select(F.explode(ngrams(raw_tokens(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def postings_tf_positions(spark: SparkSession, d: str) -> DataFrame:
    found = index.postings(index.positions(_documents(spark, d), "doc_id", "text"))
    return found.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def index_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two partial indexes merged, each term's postings written as a line and read again."""
    p = index.postings(index.positions(_documents(spark, d), "doc_id", "text"))
    odd, even = p.where("doc_id % 2 = 1"), p.where("doc_id % 2 = 0")
    block = index.as_block(F.col("postings"))
    lines = index.merge_partial_indexes([odd, even]).select("term", block.alias("line"))
    return lines.select("term", "line", F.size(index.from_block(F.col("line"))).cast("bigint").alias("df"))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return index.document_lengths(_documents(spark, d), "doc_id", "text")


def doc_lengths_distinct(spark: SparkSession, d: str) -> DataFrame:
    return index.document_lengths(_documents(spark, d), "doc_id", "text", length_mode="distinct")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return index.corpus_stats(index.document_lengths(docs, "doc_id", "text"), docs.select(F.explode(tokens(F.col("text"))).alias("term")), avg_len_round=2)


def length_facet(spark: SparkSession, d: str) -> DataFrame:
    f = index.length_facet(index.document_lengths(_documents(spark, d), "doc_id", "text"))
    return f.select("count", "total", "min", "max", *(F.round(c, 4).alias(c) for c in ("mean", "sum_of_squares", "variance", "std_deviation")))


def approx_vocab(spark: SparkSession, d: str) -> DataFrame:
    return index.approximate_vocabulary(_documents(spark, d).select(F.explode(tokens(F.col("text"))).alias("term")))


def approx_vocab_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketch's number of terms is within two in a hundred of the exact one."""
    terms = _documents(spark, d).select(F.explode(tokens(F.col("text"))).alias("term"))
    both = index.approximate_vocabulary(terms, 0.01).crossJoin(terms.agg(F.count_distinct("term").alias("exact")))  # two single rows
    return both.select((F.abs(F.col("v") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within"))


def index_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Where each posting block begins in a file of all blocks in term order, and its bytes."""
    p = index.postings(index.positions(_documents(spark, d), "doc_id", "text"))
    lines = index.merge_partial_indexes([p]).select("term", "block", index.as_block(F.col("postings")).alias("line"))
    return index.catalog(lines, ["term", "block"], "line")


def term_stats_df_ttf_tlen(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms


def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.term_lookup(_index(spark, d).postings, LOOKED_UP).select("term", "doc_id", "tf", "len")


def term_vector(spark: SparkSession, d: str) -> DataFrame:
    return index.term_vector(_index(spark, d).postings, 1)


# -- ranking


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _run(model: str, kept: str = "no_stopwords"):
    """The run of one term model, over documents as streams of chunks."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        terms = ranking.query_terms(table(spark, d, "topics"), model=kept) if MODELS[kept]["stem"] else _terms(spark, d)
        return runs.run(runs.chunks_of(_documents(spark, d), d, kept), terms, model)

    return run


rank_okapi, rank_tfidf, rank_bm25, rank_laplace, rank_jm = (_run(m) for m in ranking.TERM_MODELS)
rank_bm25_original = _run("bm25", "original")
rank_bm25_stems_only = _run("bm25", "stemmed")  # stems, and keeps stop words
rank_bm25_stemmed = _run("bm25", "no_stopwords_stemmed")


def min_window(spark: SparkSession, d: str) -> DataFrame:
    return runs.windows(runs.chunks_of(_documents(spark, d), d, positions=True), _terms(spark, d))


def rank_proximity(spark: SparkSession, d: str) -> DataFrame:
    return runs.proximity(runs.chunks_of(_documents(spark, d), d, positions=True), _terms(spark, d))


def borda_fusion(spark: SparkSession, d: str) -> DataFrame:
    return runs.fusion(runs.chunks_of(_documents(spark, d), d), _terms(spark, d))


SOUGHT = "the old bridge, a patrol and an inspector of schools"


def free_text_search(spark: SparkSession, d: str) -> DataFrame:
    return ranking.search(_index(spark, d), SOUGHT).select("doc_id", "docno", "rank", "score")


def legacy_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics").select("query_no", F.posexplode(legacy_query_tokens(F.col("text"))).alias("pos", "term"))


def trec_run_text(spark: SparkSession, d: str) -> DataFrame:
    return runs.lines(runs.chunks_of(_documents(spark, d), d), _terms(spark, d), "bm25")


# -- evaluation


def _matrix_run(spark: SparkSession, d: str, score: str = "bm25_score") -> DataFrame:
    last = learn.latest_features(table(spark, d, "data_matrix_with_queryno_docno"), ["queryno", "docno"], SCORES, "scored_at")
    return last.where(F.col(score) != 0).select(F.col("queryno").alias("query_no"), "docno", F.col(score).alias("score"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return ev.judged_run(_matrix_run(spark, d), table(spark, d, "qrels"))


def qrels_agg(spark: SparkSession, d: str) -> DataFrame:
    return ev.relevant_counts(table(spark, d, "qrels"))


def eval_prec_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return ev.precision_recall_at(_judged(spark, d)).select("query_no", "cutoff", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def eval_f1(spark: SparkSession, d: str) -> DataFrame:
    return ev.precision_recall_at(_judged(spark, d)).select("query_no", "cutoff", F.round("f1", 6).alias("f1"))


def eval_avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return ev.average_precision(_judged(spark, d)).select("query_no", F.round("avg_prec", 6).alias("avg_prec"))


def eval_rprec(spark: SparkSession, d: str) -> DataFrame:
    return ev.r_precision(_judged(spark, d)).select("query_no", F.round("r_prec", 6).alias("r_prec"))


def eval_interp11(spark: SparkSession, d: str) -> DataFrame:
    return ev.interpolated_precision(_judged(spark, d)).select("query_no", "recall", F.round("precision", 6).alias("precision"))


def eval_ndcg(spark: SparkSession, d: str) -> DataFrame:
    run = _judged(spark, d)
    both = ev.ndcg(run).join(ev.ndcg(run, log2=True).withColumnRenamed("ndcg", "ndcg_log2"), "query_no")
    return both.select("query_no", F.round("ndcg", 6).alias("ndcg"), F.round("ndcg_log2", 6).alias("ndcg_log2"))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ev.summary(cut(_judged(spark, d), "judged"))
    return s.select("topics", "retrieved", "relevant", "relevant_retrieved", *(F.round(c, 6).alias(c) for c in ("map", "r_prec", "ndcg")))


def trec_eval_report(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of the BM25 scores as text, a topic's lines and the totals'."""
    return ev.report(cut(_judged(spark, d), "judged"))


def judged_total(spark: SparkSession, d: str) -> DataFrame:
    return ev.judged_total(table(spark, d, "qrels"))


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return ev.pr_curve(_judged(spark, d)).select("query_no", "i", *(F.round(c, 6).alias(c) for c in ("recall", "prec", "interp_prec")))


# -- pages and links


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *columns).dropDuplicates(["page_id"])


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return web.page_links(_pages(spark, d, "html_source"), "page_id", "html_source")


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return web.parsed_pages(_pages(spark, d, "html_source"), "page_id", "html_source").select("page_id", "title", "text")


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return web.html_pages(_pages(spark, d, "url", "header"), "header").select("page_id", "url")


def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    return web.canonical_links(table(spark, d, "pages"), "url", "out_links")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(table(spark, d, "pages"), "url", "out_links")


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def inlinks(spark: SparkSession, d: str) -> DataFrame:
    return graph.inlinks(_edges(spark, d))


def inlink_lists(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_edges(spark, d), "dst", "src").select("page", "part", F.array_join("neighbours", " ").alias("neighbours"))


def outdegree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degree(_edges(spark, d))


def sink_pages(spark: SparkSession, d: str) -> DataFrame:
    return graph.sink_pages(_edges(spark, d))


def pagerank_k(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(cut(_edges(spark, d), "edges"), rounds=3).select("node", F.round("score", 9).alias("score"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """To convergence."""
    return graph.pagerank(cut(_edges(spark, d), "edges")).select("node", F.round("score", 9).alias("score"))


def _root(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """The thousand pages with most in-links."""
    return graph.top(graph.inlinks(edges).select(F.col("dst").alias("node"), "n"), "n", "node", 1000).select("node")


def hits_base_set(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.base_set(edges, _root(spark, d, edges))


def hits_k(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(_edges(spark, d), "edges")
    return graph.hits(edges, _root(spark, d, edges), rounds=2).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(_edges(spark, d), "edges")
    scores = graph.hits(edges, _root(spark, d, edges))
    return graph.top(scores, "authority", "node", 500).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


def _found_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").where(F.col("url").isNotNull())
    arrive = F.col("page_id").alias("arrive")
    return p.select(F.lit("").alias("src"), "url", F.lit(0).alias("wave"), arrive).unionByName(p.select(F.col("url").alias("src"), F.explode("out_links").alias("url"), F.lit(1).alias("wave"), arrive))


def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    return web.frontier_order(_found_links(spark, d))


def merge_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select(F.explode("out_links").alias("url"))
    return web.insert_if_absent(table(spark, d, "pages").select("url"), links, "url")


ROBOTS = """# for all
User-agent: *
Disallow: /sport   # but not all of it
Allow: /sport/m
Disallow: /tech

User-agent: other
Disallow: /
"""


def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    """The links that may be fetched where every host gives the same rules file, but for those whose host ends in ``.test``, which have none."""
    links = table(spark, d, "pages").select(F.explode("out_links").alias("url")).where(F.col("url").isNotNull())
    hosts = links.select(host_key(F.col("url")).alias("host"))

    def fetch(url: str) -> web.Page | None:
        return None if url.endswith(".test/robots.txt") else web.Page(200, "text/plain", ROBOTS)

    return web.robots_filter(links, "url", web.robots_table(web.fetched_robots(hosts, "host", fetch), "host", "text"))


def seed_hosts(spark: SparkSession, d: str) -> DataFrame:
    return web.seed_hosts(table(spark, d, "pages"), "url")


# -- mails


def _mails(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "mails").select("mail_id", *columns).dropDuplicates(["mail_id"])


def mail_clean(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d, "body").select("mail_id", mail.collapse_blanks(mail.clean_body(F.col("body"))).alias("body"))


def mail_labels_joined(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d, "file_name").join(labelled_files(table(spark, d, "mail_labels")).select("file_name", "label"), "file_name").select("mail_id", "file_name", "label")


def bigram_match(spark: SparkSession, d: str) -> DataFrame:
    return mail.bigram_matches(tokenize_original(spark, d), *BIGRAM, ident="doc_id")


def ngram_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    split = F.lower(F.trim("split")).alias("split")
    return mail.ngram_matrix(_mails(spark, d, "body", "label", split), "mail_id", "body", "label", "split", (*mail.SPAM_NGRAMS, "as far", "reply before"))


def sparse_matrix(spark: SparkSession, d: str) -> DataFrame:
    toks = mail.mail_tokens(table(spark, d, "mails"), "mail_id", "body")
    m = mail.sparse_matrix(cut(toks, "tokens"))
    labels = _mails(spark, d, "label").select("mail_id", mail.label_of(F.col("label")).alias("label"))
    return mail.libsvm_lines(m.join(labels, "mail_id", "left"), "label", "features")


def term_ids(spark: SparkSession, d: str) -> DataFrame:
    return mail.term_ids(mail.mail_tokens(table(spark, d, "mails"), "mail_id", "body"))


def sparse_matrix_split(spark: SparkSession, d: str) -> DataFrame:
    """The same lines dealt to training and test, each with its mail."""
    m = mail.sparse_matrix(cut(mail.mail_tokens(table(spark, d, "mails"), "mail_id", "body"), "tokens"))
    split = F.when(F.lower(F.trim("split")) == "train", "train").otherwise("test").alias("split")
    labels = _mails(spark, d, "label", "split").select("mail_id", split, mail.label_of(F.col("label")).alias("label"))
    return mail.libsvm_lines(m.join(labels, "mail_id"), "label", "features", ("split", "mail_id"))


# -- learning


def ltr_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    qrels = table(spark, d, "qrels")
    runs = {s.replace("_score", ""): _matrix_run(spark, d, s) for s in SCORES}
    m = learn.ltr_matrix(qrels, runs)
    return m.select("query_no", "docno", *(F.round(n, 6).alias(n) for n in runs), "label")


def ltr_regression(spark: SparkSession, d: str) -> DataFrame:
    m = cut(learn.latest_features(table(spark, d, "data_matrix_with_queryno_docno"), ["queryno", "docno"], SCORES, "scored_at"), "features")
    return learn.ltr_runs(m, "queryno", "docno")


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", learn.modulo_split(F.col("doc_id")).alias("split"))


def spam_tree(spark: SparkSession, d: str) -> DataFrame:
    m = cut(ngram_feature_matrix(spark, d), "matrix")
    features = [c for c in m.columns if c not in ("mail_id", "label")]
    model = learn.spam_tree(m, features)
    return learn.tree_predictions(m, model, features).select("mail_id", "prediction", "p_spam", "label")


def spam_tree_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten mails the tree takes most surely for spam."""
    return graph.top(spam_tree(spark, d), "p_spam", "mail_id", 10)


def accuracy_by_split(spark: SparkSession, d: str) -> DataFrame:
    m = learn.latest_features(table(spark, d, "data_matrix_with_queryno_docno"), ["queryno", "docno"], SCORES, "scored_at")
    m = m.withColumn("predicted", (F.col("bm25_score") > 5).cast("int")).withColumn("split", learn.modulo_split(F.col("queryno").cast("bigint")))
    return learn.confusion_by(m, "label", "predicted", "split").withColumn("accuracy", F.round("accuracy", 6))


def top_weights(spark: SparkSession, d: str) -> DataFrame:
    """The thousand terms that speak most for spam, by a linear model of the training mails."""
    label = mail.label_of(F.col("label"), F.lower(F.trim("split"))).alias("label")
    rows = cut(_mails(spark, d, "body", "label", "split").select(raw_tokens(F.col("body")).alias("tokens"), label), "mails")
    return learn.top_terms(learn.linear_weights(rows, "tokens", "label")).select("term", F.round("weight", 6).alias("weight"))


def accuracy_confusion(spark: SparkSession, d: str) -> DataFrame:
    m = learn.latest_features(table(spark, d, "data_matrix_with_queryno_docno"), ["queryno", "docno"], SCORES, "scored_at")
    c = learn.confusion(m.withColumn("predicted", (F.col("bm25_score") > 5).cast("int")), "label", "predicted")
    return c.withColumn("accuracy", F.round("accuracy", 6))


def top_n_by_value(spark: SparkSession, d: str) -> DataFrame:
    return graph.top(_documents(spark, d).select("doc_id", "n_chars"), "n_chars", "doc_id", 500)


def stop_words(spark: SparkSession, d: str) -> DataFrame:
    """The stop words that occur, with their documents."""
    words = _documents(spark, d).select("doc_id", F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("word")).where(F.col("word").isin(STOP_WORDS))
    return words.groupBy("word").agg(F.count("*").alias("df"))


# -- text formats, written to the shared folder and read again


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"text-{name}")


def collection_text(spark: SparkSession, d: str) -> DataFrame:
    """The stories as tagged documents."""
    path = _scratch(spark, "collection")
    doc = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n<TEXT>\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n</DOC>"))
    _documents(spark, d).select(doc.alias("value")).write.text(path)
    return files.read_collection(spark, path)


def topics_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "topics")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    table(spark, d, "topics").where(text != "").select(F.concat("query_no", F.lit(".   "), text).alias("value")).write.text(path)
    return files.read_topics(spark, path)


def run_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "run")
    files.write_run(index.ranked(_matrix_run(spark, d), ["query_no"], "score", ["docno"], 1000), path)
    return files.read_run(spark, path)


def qrels_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "qrels")
    rows = table(spark, d, "qrels").select("query_no", F.coalesce("assessor", F.lit("0")).alias("assessor"), "docno", F.coalesce("rel", F.lit(0)).alias("rel"))
    rows.select(F.concat_ws(" ", *rows.columns).alias("value")).write.text(path)
    return files.read_qrels(spark, path)


def adjacency_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "links")
    files.write_adjacency(_edges(spark, d), path)
    return files.read_adjacency(spark, path)


def scores_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their in-links, best first, as lines that are read as words."""
    path = _scratch(spark, "scores")
    files.write_scores(graph.inlinks(_edges(spark, d)), path, "dst", "n")
    return spark.read.text(path).select(F.col("value").alias("line"))


def words_text(spark: SparkSession, d: str) -> DataFrame:
    """The terms of the mails as a list, one a line."""
    path = _scratch(spark, "words")
    mail.mail_tokens(table(spark, d, "mails"), "mail_id", "body").select(F.upper("term").alias("value")).distinct().write.text(path)
    return files.read_words(spark, path)


def root_set_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "root")
    _root(spark, d, _edges(spark, d)).select(F.col("node").alias("value")).write.text(path)
    return files.read_nodes(spark, path)


def mail_labels_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "labels")
    table(spark, d, "mail_labels").where(F.col("label").isNotNull() & F.col("path").isNotNull()).select(F.concat_ws(" ", "label", "path").alias("value")).write.text(path)
    return files.read_mail_labels(spark, path)


def arff_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "arff")
    m = learn.latest_features(table(spark, d, "data_matrix_with_queryno_docno"), ["queryno", "docno"], SCORES, "scored_at")
    files.write_arff(m, path, "documents", {**dict.fromkeys(SCORES, "numeric"), "label": "numeric"})
    return files.read_arff(spark, path)


def libsvm_text(spark: SparkSession, d: str) -> DataFrame:
    """Label, distinct terms and all terms of each mail, read from the lines."""
    path = _scratch(spark, "libsvm")
    toks = mail.mail_tokens(table(spark, d, "mails"), "mail_id", "body")
    labels = _mails(spark, d, "label").select("mail_id", mail.label_of(F.col("label")).alias("label"))
    files.write_libsvm(mail.sparse_matrix(cut(toks, "tokens")).join(labels, "mail_id", "left"), path)
    values = F.map_values("features")
    return files.read_libsvm(spark, path).select("label", F.size("features").alias("terms"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"))
