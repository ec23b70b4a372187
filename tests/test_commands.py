import json

from figloom.__main__ import parser, run


def said(spark, capsys, *args):
    code = run(spark, parser().parse_args([str(a) for a in args]))
    return code, capsys.readouterr().out.split("\n")


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "names").write_text("README.md\ndata/b_reject.tar.gz\ndata/a_oral.tar.gz\ndata.jsonl\nreproduce/x_metadata.tar.gz\n")
    assert said(spark, capsys, "select", tmp_path / "names") == (0, ["data.jsonl", "data/a_oral.tar.gz", ""])
    assert said(spark, capsys, "select", tmp_path / "names", "--subset", "all", "--no-core", "--metadata")[1][:3] == ["data/b_reject.tar.gz", "data/a_oral.tar.gz", "reproduce/x_metadata.tar.gz"]

    def papers(name, *rows):
        (tmp_path / name).write_text("".join(json.dumps(dict(zip(("platform_id", "year", "decision"), r))) + "\n" for r in rows))
        return tmp_path / name

    one = papers("one.jsonl", ("a", 2024, "pending/unknown"), ("b", 2024, "Reject"))
    two = papers("two.jsonl", ("a", 2024, "Accept (Oral)"), ("b", 2024, "REJECT"), ("c", 2025, "pending/unknown"))
    assert "published:" in said(spark, capsys, "sync", one, tmp_path / "root")[1][0]
    out = said(spark, capsys, "sync", two, tmp_path / "root")[1]
    assert out[:2] == ["new: 1", "changed: 1"] and out[2].endswith("00000002")
    said(spark, capsys, "tasks", two, "https://h", tmp_path / "tasks", "--limit", 2)
    tasks = [json.loads(x) for p in sorted((tmp_path / "tasks").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(t["id"], t["decision"], t["url"]) for t in tasks] == [("a", "accept_oral", "https://h/pdf?id=a"), ("b", "reject", "https://h/pdf?id=b")]
    tree = tmp_path / "V"
    for kind, name in (("papers", "main.pdf"), ("figures", "Figure1.png")):
        folder = tree / kind / "2024" / "pending_unknown" / "a"
        folder.mkdir(parents=True)
        (folder / name).write_bytes(b"z" * 2048)
    assert said(spark, capsys, "moves", tree, two, "--dry-run")[1][:3] == ["all eligible 1", "figures moved 1", "papers moved 1"]
    assert (tree / "papers/2024/pending_unknown/a").exists()
    said(spark, capsys, "moves", tree, two)
    assert (tree / "figures/2024/accept_oral/a/Figure1.png").exists()
    stats = said(spark, capsys, "stats", tmp_path)[1]
    assert stats[0].split() == ["V", "2024", "accept_oral", "Accept", "2.0", "KB"] and stats[1:3] == ["Accept 2.0 KB", "Total 2.0 KB"]
    (tmp_path / "release.jsonl").write_text('{"id": 0, "venue": "ICLR"}\n{"id": 1, "venue": null}\n')
    code, out = said(spark, capsys, "validate", tmp_path / "release.jsonl", "--rows", 2, "--file", f"names={tmp_path / 'names'}")
    assert code == 0 and out[:3] == ["ok   rows expected 2, found 2", "ok   ids expected 2, found 2", "ok   file names expected 1, found 1"] and "venue ICLR 1" in out
    assert said(spark, capsys, "validate", tmp_path / "release.jsonl", "--rows", 2, "--index", "title=/no/such")[0] == 1
