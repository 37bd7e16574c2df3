from loomgraph import __main__ as cli
from loomgraph.settings import Settings, get_settings


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("LOOMGRAPH_EMBEDDING_DIMENSION", "64")
    get_settings.cache_clear()
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("---\ntitle: Acme\ndocument_id: a\naccess_tier: Public\n---\n# Acme\n\nAcme Corp relies on Product Nova. Product Nova depends on Identity Service.\n")
    (folder / "b.md").write_text("# Idle\n\nIdentity Service supports OAuth 2.1.\n")
    run = lambda *a: (cli.main(["--store", str(tmp_path / "store"), *a]), capsys.readouterr().out)[1]
    try:
        assert "documents_count" in run("ingest", str(folder))
        assert "chunk_a_001" in run("search", "Acme relies on Nova", "--top-k", "1") and "chunk_b_001" in run("search", "Acme relies on Nova", "--document-id", "b")
        assert "(Acme Corp)-[:DEPENDS_ON]->(Product Nova)" in run("traverse", "acme corp")
        assert "COMPARISON" in run("analyze", "Compare Product Nova and Product Orion.")
        assert "relationship_count" in run("stats")
    finally:
        get_settings.cache_clear()


def test_settings_follow_the_environment(monkeypatch):
    get_settings.cache_clear()
    monkeypatch.setenv("LOOMGRAPH_CHUNK_SIZE", "42")
    monkeypatch.setenv("LOOMGRAPH_GRAPH_WEIGHT", "0.75")
    assert (get_settings().chunk_size, get_settings().graph_weight, get_settings().rrf_k) == (42, 0.75, 60)
    get_settings.cache_clear()
    monkeypatch.delenv("LOOMGRAPH_CHUNK_SIZE")
    monkeypatch.delenv("LOOMGRAPH_GRAPH_WEIGHT")
    assert get_settings() == Settings()
    get_settings.cache_clear()
