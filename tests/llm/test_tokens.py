from cadenza.llm.tokens import PATTERN, TOKENIZER, with_token_counts


def test_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello world", "", None, "añadir <|endoftext|>", "word " * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    got = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert with_token_counts(df.limit(0)).count() == 0
