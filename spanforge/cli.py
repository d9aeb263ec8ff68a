"""Commands: reindex, estimate, search, stats, healthcheck, version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import spanforge
from spanforge.functions import routing
from spanforge.functions.text import price_per_token
from spanforge.operators import diff, search
from spanforge.operators.documents import reconstruct
from spanforge.operators.embed import build, embed_files
from spanforge.operators.store import SnapshotStore, upserted
from spanforge.sources import config, git


class Index:
    """A repository, its settings, model and snapshots."""

    def __init__(self, spark: SparkSession, cwd: str = ".") -> None:
        self.spark, self.root = spark, git.find_root(cwd)
        self.config = config.load(self.root)
        c = self.config
        self.model = build(c.provider, c.model, c.dimensions, c.base_url, c.api_key_env)
        if not self.model.contextual:
            raise ValueError(f"{self.model.name} does not embed whole documents; a contextual model is needed")
        self.store = SnapshotStore(spark, f"file://{self.root}/{routing.STATE_DIR}/index")

    def tree(self, ref: str = "HEAD") -> DataFrame:
        return git.tree(self.spark, self.root, ref).where(routing.candidate(F.col("path"), self.config.exclude, self.config.ext_overrides))

    def rows(self) -> DataFrame:
        old = self.store.read()
        empty = self.spark.createDataFrame([], "path string, blob_sha string, model string, version long, ord long, start long, end long, embedding array<float>")
        return empty if old is None else old.where(F.col("model") == self.model.name).select(empty.columns)

    def indexed(self) -> DataFrame:
        return self.rows().groupBy("path", "model", "blob_sha", "version").agg(F.count("ord").alias("chunks"))

    def plan(self, ref: str = "HEAD", full: bool = False) -> tuple[DataFrame, DataFrame]:
        """Files to embed, with content, and the paths whose rows go."""
        tree = self.tree(ref)
        everything = git.tree(self.spark, self.root, ref)
        plan = diff.action_plan(tree, self.indexed())
        # a path that is no candidate any more keeps its rows while it is in the tree
        gone = plan.where("action = 'delete'").join(everything, "path", "left_anti")
        todo = tree if full else tree.join(plan.where("action = 'embed'"), "path", "left_semi")
        return git.with_contents(todo, self.root), todo.select("path").union(gone.select("path"))

    def reindex(self, staged: bool = False, cap: float | None = None) -> dict:
        ref = git.staged_tree(self.root) if staged else "HEAD"
        files, touched = self.plan(ref)
        diff.gate(diff.estimate(files, self.model.name), self.config.max_reindex_cost if cap is None else cap)
        if touched.limit(1).count():
            fresh = embed_files(files.repartition("path"), self.model)
            self.store.write(upserted(self.rows(), fresh, touched))
            self.store.vacuum()
        n = self.indexed().agg(F.count("*").alias("f"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("c")).first()
        # for people only; a staged run records the parent, and nothing before the first commit
        try:
            commit = git.resolve(self.root, "HEAD")
        except Exception:
            if not staged:
                raise
            commit = ""
        config.write_marker(self.root, commit, n["f"], n["c"])
        return {"files": n["f"], "chunks": n["c"]}

    def search(self, query: str, k: int = search.DEFAULT_K) -> list[dict]:
        if not query.strip():
            raise ValueError("an empty query")
        hits = search.top_k(self.rows().where("ord is not null"), self.model.embed_query(query), k)
        kept = hits.select("path", "blob_sha", "ord", "start", "end", "score").collect()  # k rows
        scores = {(r["path"], r["ord"]): r["score"] for r in kept}
        if not kept:
            return []
        found = self.spark.createDataFrame(kept, "path string, blob_sha string, ord long, start long, end long, score double")
        per_file = found.groupBy("path", "blob_sha").agg(F.collect_list(F.struct("ord", "start", "end")).alias("spans"))
        p = F.col("path")
        texts = reconstruct(git.with_contents(per_file, self.root).select("path", "content", routing.grammar(p).alias("grammar"), routing.comment_mark(p).alias("comment"), "spans"))
        rows = [{**r.asDict(), "score": scores[r["path"], r["ord"]]} for r in texts.collect()]
        return sorted(rows, key=lambda r: (r["score"] is None, -(r["score"] or 0.0), r["path"], r["ord"]))

    def health(self) -> dict:
        """Issues (path, message) and what they were found by."""
        marker, tree, indexed = config.read_marker(self.root), self.tree().cache(), self.indexed().cache()
        n = indexed.agg(F.count("*").alias("f"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("c")).first()
        out = {"head": git.resolve(self.root, "HEAD"), "commit": marker and marker.get("commit", ""), "expected_files": tree.count(), "indexed_files": n["f"], "indexed_chunks": n["c"]}
        if marker is None:
            out["issues"] = [("", "no state marker")]
        else:
            out["issues"] = [(r["path"], r["msg"]) for r in diff.health_issues(tree, indexed, marker["file_count"], marker["chunk_count"]).collect()]
        tree.unpersist()
        indexed.unpersist()
        return out


def heading(crumb: str, line: int) -> str:
    """``## file:L<line>`` and the rest of a breadcrumb."""
    file, *rest = crumb.split(" > ", 1)
    return " > ".join([f"## {file}:L{line}", *rest])


def rendered(hits: list[dict]) -> str:
    """Hits as sections, best first."""
    return "\n---\n\n".join(f"{heading(h['heading'], h['start_line'])}\n\n{h['text']}\n" for h in hits) or "No results found.\n"


def kilo(tokens: int) -> str:
    """Thousands of tokens, in three figures."""
    return f"{tokens / 1000:.3g} kTok"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, cwd: str = ".") -> int:
    p = argparse.ArgumentParser(prog="spanforge")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reindex")
    r.add_argument("--staged", action="store_true")
    r.add_argument("--max-reindex-cost", type=float)
    s = sub.add_parser("search")
    s.add_argument("-k", type=int, default=search.DEFAULT_K)
    s.add_argument("query", nargs="+")
    for name in ("estimate", "stats", "healthcheck", "version"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    if a.command == "version":
        print(spanforge.__version__)
        return 0
    index = Index(spark or SparkSession.builder.appName("spanforge").getOrCreate(), cwd)
    if a.command == "reindex":
        done = index.reindex(a.staged, a.max_reindex_cost)
        print(f"{done['files']} files, {done['chunks']} chunks")
    elif a.command == "estimate":
        print(f"Estimated costs:\n- embedding: ${price_per_token(index.model.name) * 1e6:.3g}/1M tok")
        for label, full in (("next reindex", False), ("full reindex", True)):
            row = diff.estimate(index.plan(full=full)[0], index.model.name).first()
            print(f"- {label}: {row['files']} files, {row['chunks']} chunks, {kilo(row['embed_tokens'])}, ${row['dollars']:.3g}")
    elif a.command == "search":
        query = " ".join(a.query).strip()
        if not query:
            p.error("search needs a query")
        print(rendered(index.search(query, a.k)), end="")
    elif a.command == "stats":
        print(config.read_marker(index.root) or "no state marker")
    elif a.command == "healthcheck":
        h = index.health()
        print(f"HEAD:           {h['head']}\nstate:          {'missing' if h['commit'] is None else h['commit']}\nexpected files: {h['expected_files']}\nindexed files:  {h['indexed_files']}\nindexed chunks: {h['indexed_chunks']}\n")
        print("\n".join([f"{len(h['issues'])} issue(s):", *(f"  - {path}: {msg}" if path else f"  - {msg}" for path, msg in h["issues"])]) if h["issues"] else "healthy: the index and the state marker match the tree")
        return int(bool(h["issues"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
