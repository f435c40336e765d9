"""The command line over a small tree."""

from waymark.__main__ import main


def test_modes(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("class A:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n")
    (tmp_path / "src/b.js").write_text("function use(x) { return helper(x); }\n")
    (tmp_path / "notes.md").write_text("# Title\n")

    def shown(*arguments, code=0):
        assert main(["--root", str(tmp_path), "--iterations", "2", *arguments], spark) == code
        return capsys.readouterr().out

    whole = shown()
    assert "src/a.py:" in whole and "class A" in whole and "use" in whole
    assert "src/b.js" not in shown("src/a.py", "--join") and "src/a.py" not in shown("--ext", "js", "--join")
    assert shown("--search", "HELPER").splitlines()[0] == "src/a.py:5: def helper"
    assert "src/ 2 files" in shown("--tree") and "src/a.py" in shown("--stats")
    assert "def helper():" in shown("--join")
    assert "'definition_matches': 4" in shown("--report")
    cached = ["--cache", str(tmp_path / "cache"), "--report"]
    assert shown(*cached) == shown(*cached)
    assert shown("missing", code=1) == ""
