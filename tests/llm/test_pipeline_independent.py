"""Each stage of the pipeline against a version that shares no code with its operator."""

from __future__ import annotations

import base64

import corpus_pipeline as pipeline
import duckdb
import public_tokenizers
import tiktoken
from test_op8_jaccard import brute
from test_op9_secrets import naive

from groundwell.llm import op5_bpe, op6_decontaminate

LONG = "aB3" * 700
#: Texts whose secrets only the lexer finds, and what must be left of them.
LEXED = {
    950: (f'quoted private_key = "{LONG}" end', 'quoted private_key = "[secret]" end'),
    951: (f"bare db_pwd = {LONG} end", "bare db_pwd = [secret] end"),
    952: (f"blanks private_key{' ' * 20}= '{LONG}' end", f"blanks private_key{' ' * 20}= '[secret]' end"),
    953: (f"tag <private_key>{LONG}</private_key> end", "tag <private_key>[secret]</private_key> end"),
    954: ("terms db_pwd = " + " + ".join(f'"p4ssP4ss{k:02}"' for k in range(20)), "terms db_pwd = " + " + ".join(['"[secret]"'] * 20)),
}


def masked(text: str) -> str:
    hidden = [False] * len(text)
    for a, b, _ in naive(text):
        hidden[a:b] = [True] * (b - a)
    out = []
    for k, c in enumerate(text):
        if not hidden[k]:
            out.append(c)
        elif k == 0 or not hidden[k - 1]:
            out.append("[secret]")
    return "".join(out)


def test_stages_agree_with_independent_versions(spark, tmp_path, docs):
    leak = " ".join(f"leak{k}" for k in range(20))
    base = {900: "a token = 'abcdef0123456789abcdef0123456789' here", 901: f"before {leak} after"}
    texts = base | {d: t for d, (t, _) in LEXED.items()}
    more = spark.createDataFrame([(t, 1, "c", d, 1, "en", "s", len(t), 1, 0) for d, t in texts.items()], docs.schema)
    docs.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, leak), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(pipeline.STAGES)

    def after(name: str, df):
        stages[name](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        return out, {r.doc_id: r.text for r in out.collect()} if name != "tokens" else {r.doc_id: (r.n_tokens, list(r.ids)) for r in out.collect()}

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.text for r in df.collect()}
    df, kept = after("language", df)
    assert kept == {d: t for d, t in before.items() if any(c.isalpha() for c in t or "")}

    before = kept
    df, kept = after("near_duplicates", df)
    assert kept == {d: before[d] for d in {g for _, g in brute(before, 5, 80).values()}} and len(kept) < len(before)

    before = kept
    df, kept = after("decontamination", df)
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar)")
    con.sql("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(d, t.replace("\x00", " ")) for d, t in before.items()])  # NUL is a separator that DuckDB can't hold
    con.executemany("insert into benchmark values (?, ?)", items)
    bad = {r[0] for r in con.sql(f"select doc_id from ({op6_decontaminate.ORACLE}) where contaminated").fetchall()}
    assert kept == {d: t for d, t in before.items() if d not in bad} and bad == {901}

    before = kept
    df, kept = after("secrets", df)
    assert set(LEXED) <= set(before)
    assert kept == {d: LEXED[d][1] if d in LEXED else masked(t) for d, t in before.items()}

    before = kept
    _, ids = after("tokens", df)
    with open(public_tokenizers.path(op5_bpe.RANKS_FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: coder.encode_ordinary(t) for d, t in before.items()}
    assert ids == {d: (len(w), w) for d, w in want.items()}
