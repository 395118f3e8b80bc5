from __future__ import annotations

import json
import sys
from types import SimpleNamespace

import pytest

from vellum import cli
from vellum.config import Config, ConfigError, missing_keys, setup_logging
from vellum.plans import pipelines
from vellum.sources import files, sinks
from vellum.streaming import documents

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
TOML = '[paths]\ninput_path = "in"\noutput_path = "out"\n[data]\nmachine_solution_path = "m.json"\nuser_solution_path = "u.json"\n[unicode_replacements]\nreplacements_on = true\ncharacters_to_delete = ["❧"]\n[unicode_replacements.characters_to_replace]\n"ſ" = "s"\n[language_model_integration]\nprovider = "openai"\n[dataset]\nstratify_by = "abbreviated_word_length"\n[validation]\nminimum_context_length = 0\n'


@pytest.fixture
def project(tmp_path):
    (tmp_path / "config.toml").write_text(TOML)
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "u.json").write_text(json.dumps({"co$": "con", "A$": ["Aa", "x"]}))
    (tmp_path / "m.json").write_text(json.dumps({"co$": ["con", "com"]}))
    (tmp_path / "in/a.xml").write_text(f"<TEI {NS}><text><p>one <abbr>co$</abbr> two ſ❧</p><p><abbr>omnib;</abbr></p></text></TEI>")
    (tmp_path / "in/deep/b.xml").write_text(f"<TEI {NS}><p>x <abbr>co$</abbr> later</p></TEI>")
    (tmp_path / "in/bad.xml").write_text("<TEI>")
    (tmp_path / "in/c.XML").write_text("<TEI/>")
    return tmp_path


def test_config(project):
    c = Config(project / "config.toml")
    assert c.get("paths", "input_path") == "in" and c.get("paths")["output_path"] == "out"
    assert c.get("paths", "none", 3) == 3 and c.get("none", "x", "d") == "d"
    for section, key in (("paths", "none"), ("none", None), ("none", "x")):
        with pytest.raises(KeyError):
            c.get(section, key)
    c.validate_paths()
    assert (project / "out").is_dir() and ("paths", "input_path", "in") in c.recap() and c.ambiguous() == []
    assert Config(values={"ambiguity": {"ambiguous_aws": ["yt"]}}).ambiguous() == ["yt"]
    assert missing_keys(c, {}) and not missing_keys(c, {"OPENAI_API_KEY": "k"})
    with pytest.raises(FileNotFoundError):
        Config(project / "none.toml")
    (project / "bad.toml").write_text("[")
    with pytest.raises(ConfigError):
        Config(project / "bad.toml")
    (project / "u.json").unlink()
    with pytest.raises(FileNotFoundError):
        c.validate_paths()
    assert setup_logging(str(project / "logs")).name == "vellum"


def test_sources(spark, project):
    found = [r["file_path"] for r in files.xml_files(spark, str(project / "in")).collect()]
    assert sorted(f.rsplit("/", 1)[1] for f in found) == ["a.xml", "b.xml", "bad.xml"]
    assert len(files.list_xml(str(project / "in"))) == 3
    assert files.pick(["a", "b", "c"], "3, 1,9") == ["c", "a"] and files.pick(["a", "b"], "x") == ["a"]
    assert files.read_solutions(project / "u.json") == {"co$": ["con"], "A$": ["Aa", "x"]}
    assert files.read_solutions(project / "none") == {} and files.read_solutions(project / "config.toml") == {}
    assert files.read_or_create(project / "new/d.json") == {} and (project / "new/d.json").exists()
    rows = files.load_dictionaries(spark, str(project / "u.json"), str(project / "m.json")).collect()
    assert [(r["dict"], r["key_ord"], r["abbr"]) for r in rows] == [("user", 0, "co$"), ("user", 1, "A$"), ("machine", 0, "co$")]


def test_pipelines(spark, project):
    c = Config(project / "config.toml")
    rows = {r["file_path"].rsplit("/", 1)[1]: r for r in pipelines.expand_documents(spark, c, str(project / "in"), str(project / "out")).collect()}
    assert rows["a.xml"]["expanded"] == 2 and rows["a.xml"]["saved"] and rows["bad.xml"]["expanded"] == 0
    assert "<expan" in (project / "out/a.xml").read_text() and ">omnibus</expan>" in (project / "out/a.xml").read_text()
    decided = {r["abbr_key"]: r["expansion"] for r in pipelines.decide(spark, c, str(project / "in")).collect()}
    assert decided == {"co$": "con", "omnib;": "omnibus"}
    counts = {r["split"]: r["n"] for r in pipelines.build_dataset(spark, c, str(project / "in"), str(project / "data"), system_message="s").collect()}
    assert sum(counts.values()) == 3 and spark.read.json(str(project / "data/entries")).count() == 3
    summary = pipelines.replace_characters(spark, c, str(project / "in/a.xml"), str(project / "rep")).first()
    assert summary["deleted"] == 1 and summary["files"] == 1 and "s</p>" in (project / "rep/texts/a.xml").read_text()
    stats = {(r["part"], r["metric"]): r["value"] for r in pipelines.statistics(spark, c, str(project / "in")).collect()}
    assert stats["documents", "malformed_abbr"] == 1 and stats["session", "files_processed"] == 2 and stats["session", "abbreviations_expanded"] == 3 and stats["suggestions", "dictionary_matches"] == 2


def run_menu(spark, project, config, *answers):
    said, left = [], list(answers)

    def ask(question):
        said.append(f"? {question}")
        return left.pop(0)

    session = cli.menu(spark, config, str(project / "in"), str(project / "out"), ask, said.append)
    assert not left
    return session, said


def test_automatic_menu(spark, project):
    (project / "config.toml").write_text(TOML + "[user_interface]\ninteractive_mode = false\n")
    c = Config(project / "config.toml")
    # All files; statistics; a dataset of the decisions; the settings; an unknown choice; leave with saving.
    session, said = run_menu(spark, project, c, "1", "y", "4", "3", "5", "9", "6", "y")
    assert "3 XML files" in said and "2 files processed, 3 expansions" in said and "2 decisions" in said
    assert "session files_processed: 2" in said and "session abbreviations_expanded: 3" in said and any("paths.input_path" in x for x in said)
    saved = [p for p in (project / "out").glob("user_decisions_*")]
    assert len(saved) == 1 and spark.read.json(str(saved[0])).count() == 2
    # Files by number; a later decision takes the place of an earlier one; nothing saved.
    _, said = run_menu(spark, project, c, "1", "n", "3, 1, 9", "1", "n", "", "6", "n")
    assert "1. a.xml" in said and "3. deep/b.xml" in said and "2 files processed, 3 expansions" in said
    assert len([p for p in (project / "out").glob("user_decisions_*")]) == 1


def test_interactive_menu(spark, project):
    c = Config(project / "config.toml")
    session, said = run_menu(spark, project, c, "1", "n", "1,3", "c", " quando ", "1", "c", "x", "6", "y")
    # The first file's first abbreviation gets a custom expansion, its second the first suggestion; that of the other is too short.
    got = {r["abbr_key"]: (r["expansion"], r["source"], r["confidence"]) for r in session.decided.collect()}
    assert got == {"co$": ("quando", "custom", 1.0), "omnib;": ("omnibus", "pattern", 0.4)} and "skipped" in said
    assert (session.files_processed, session.abbreviations_expanded) == (2, 2)
    assert json.loads((project / "u.json").read_text()) == {"co$": ["con", "quando"], "A$": ["Aa", "x"]}
    assert any(x.startswith("1/2: co$ (<abbr>)") for x in said) and any("2. quando" in x for x in said)
    # Skipping everything leaves nothing to save.
    session, said = run_menu(spark, project, c, "1", "n", "3", "s", "6")
    assert session.decided is None and session.files_processed == 1


def test_words(spark, project):
    c = Config(project / "config.toml")
    session, said = run_menu(spark, project, c, "2", "co$", "quia", "com", "omniā", "", "c", "omniam", "co$", "", "s", "k", "", "exit", "6", "y")
    assert any(x.startswith("con  0.80") for x in said) and "looked up as omnia$" in said and "no suggestions" in said and "2 decisions" in said
    got = {r["abbr_key"]: (r["expansion"], r["source"], r["context_before"]) for r in session.decided.collect()}
    assert got == {"co$": ("com", "manual", "quia"), "omniā": ("omniam", "custom", "")}
    assert json.loads((project / "u.json").read_text())["omniā"] == ["omniam"]


def test_conflicts(spark, project):
    (project / "u.json").write_text(json.dumps({"z": ["one"], "b$": "bus", "same": ["x", "y"], "yt": "that"}))
    (project / "m.json").write_text(json.dumps({"same": ["x", "y"], "b$": ["ber"], "z": ["two", "three"], "yt": "yet", "only": "m"}))
    (project / "config.toml").write_text(TOML + '[ambiguity]\nambiguous_aws = ["yt"]\n')
    c = Config(project / "config.toml")
    said, answers = [], ["u", "M"]
    cli.Session(spark, c, "", "", lambda q: said.append(q) or answers.pop(0), said.append).conflicts()
    assert [x[:2] for x in said[:2]] == ["b$", "z:"] and said[-1] == "2 conflicts resolved"
    assert list(json.loads((project / "m.json").read_text()).items()) == [("same", ["x", "y"]), ("b$", ["bus"]), ("z", ["two", "three"]), ("yt", ["yet"]), ("only", ["m"])]
    assert list(json.loads((project / "u.json").read_text()).items()) == [("z", ["two", "three"]), ("b$", ["bus"]), ("same", ["x", "y"]), ("yt", ["that"])]
    assert pipelines.conflicts(spark, c).count() == 0


def test_language_model(spark, monkeypatch):
    model = {"language_model_integration": {"provider": "OpenAI", "model_name": "m", "suggestion_count": 2}}
    for name in ("OPENAI_API_KEY", "MISTRAL_API_KEY", "MISTRAL_ENDPOINT"):
        monkeypatch.delenv(name, raising=False)
    assert pipelines.provider(Config(values=model)) is None
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    made = pipelines.provider(Config(values=model))
    body = json.loads(made.request("text").data)
    assert (made.count, body["model"], body["n"], [m["role"] for m in body["messages"]]) == (2, "m", 1, ["system", "user"]) and made.request("x").get_header("Authorization") == "Bearer k"
    assert pipelines.provider(Config(values={"language_model_integration": {"enabled": False}})) is None
    with pytest.raises(ValueError):
        pipelines.provider(Config(values={"language_model_integration": {"provider": "other"}}))
    mistral = Config(values={"language_model_integration": {"provider": "mistral", "model_name": "t"}})
    monkeypatch.setenv("MISTRAL_API_KEY", "k")
    assert pipelines.provider(mistral) is None and len(missing_keys(mistral)) == 1
    monkeypatch.setenv("MISTRAL_ENDPOINT", "http://127.0.0.1:9/x")
    made = pipelines.provider(mistral)
    assert made.request("p").full_url == "http://127.0.0.1:9/x" and json.loads(made.request("p").data) == {"prompt": "p", "model": "t", "num_outputs": 1, "temperature": 0.7}
    assert made.answer(["p"]) == [None]


def test_main_and_arguments(spark, project, capsys, monkeypatch):
    monkeypatch.chdir(project)
    assert cli.main(["-c", str(project / "none.toml"), "-q"]) == 1
    assert cli.main(["-c", str(project / "config.toml"), "-q", "-p", str(project / "none.xml")]) == 1
    (project / "m.json").rename(project / "other.json")
    assert cli.main(["-c", str(project / "config.toml"), "-q"]) == 1 and "data.machine_solution_path" in capsys.readouterr().err
    (project / "other.json").rename(project / "m.json")
    monkeypatch.setattr(cli, "local_session", lambda cores: spark)
    assert cli.main(["-c", str(project / "config.toml"), "-q"]) == 1 and "3 files, 3 expansions, 1 failed" in capsys.readouterr().out
    assert cli.main(["-c", str(project / "config.toml"), "-q", "-p", str(project / "in/a.xml"), "-o", str(project / "one")]) == 0 and (project / "one/a.xml").exists()
    a = cli.arguments(["-i", "x", "-o", "y", "-v"])
    assert (a.config, a.input, a.output, a.quiet, a.verbose, a.process, a.conflicts) == ("config.toml", "x", "y", False, True, None, False)


def test_dataset_formats(spark, project):
    (project / "config.toml").write_text(TOML.replace('[dataset]', '[dataset]\nformat = "json"'))
    pipelines.build_dataset(spark, Config(project / "config.toml"), str(project / "in"), str(project / "data")).collect()
    assert sum(len(json.loads((project / f"data/{s}.json").read_text())) for s in ("train", "validation", "test")) == 3


def test_stream(spark, project):
    words = files.load_dictionaries(spark, str(project / "u.json"), str(project / "m.json"))
    go = lambda: documents.run(spark, str(project / "in"), str(project / "table"), words, str(project / "check")).awaitTermination()
    assert documents.current_decisions(spark, str(project / "table")).count() == 0
    go()
    first = {r["abbr_key"]: r["expansion"] for r in documents.current_decisions(spark, str(project / "table")).collect()}
    assert first == {"co$": "con", "omnib;": "omnibus"}
    (project / "in/later.xml").write_text(f"<TEI {NS}><p><abbr>ideoq;</abbr></p></TEI>")
    go()
    second = {r["abbr_key"] for r in documents.current_decisions(spark, str(project / "table")).collect()}
    assert second == {"co$", "omnib;", "ideoq;"}


def test_lemmas_for_single_letters(spark, project, monkeypatch):
    (project / "in/a.xml").write_text(f"<TEI {NS}><p>x <abbr>M</abbr> y <abbr>co$</abbr> z <abbr>k</abbr></p></TEI>")
    (project / "lemmas.txt").write_text("mulus\nmagister\n\nme\nmons\nmagister\nmanus\n")
    on = TOML.replace("[data]", '[data]\nlemmas_path = "lemmas.txt"')
    (project / "config.toml").write_text(on)
    c = Config(project / "config.toml")
    decided = {r["abbr_key"]: (r["expansion"], r["source"]) for r in pipelines.decide(spark, c, str(project / "in/a.xml")).collect()}
    assert decided == {"M": ("magister", "wordnet"), "co$": ("con", "dictionary"), "k": ("k", "language_model")}
    stats = {r["metric"]: r["value"] for r in pipelines.statistics(spark, c, str(project / "in/a.xml")).where("part = 'suggestions'").collect()}
    assert stats["wordnet_suggestions"] == 1 and stats["lm_suggestions"] == 1
    pipelines.expand_documents(spark, c, str(project / "in/a.xml"), str(project / "out")).collect()
    assert ">magister</expan>" in (project / "out/a.xml").read_text()
    assert cli.expand_word(spark, c, "m") == [("magister", 0.6, "wordnet"), ("manus", 0.6, "wordnet"), ("mons", 0.6, "wordnet")]
    words = files.load_dictionaries(spark, str(project / "u.json"), str(project / "m.json"))
    documents.run(spark, str(project / "in"), str(project / "table"), words, str(project / "check"), lemmas=pipelines.lemmas(spark, c)).awaitTermination()
    assert {r["abbr_key"]: r["source"] for r in documents.current_decisions(spark, str(project / "table")).collect()}["M"] == "wordnet"
    (project / "config.toml").write_text(on + "[settings]\nuse_wordnet = false\n")
    assert pipelines.lemmas(spark, Config(project / "config.toml")) is None
    # Without a file WordNet is read, as far as it is installed.
    (project / "config.toml").write_text(TOML)
    monkeypatch.setitem(sys.modules, "nltk.corpus", None)
    assert pipelines.lemmas(spark, Config(project / "config.toml")) is None
    synsets = [SimpleNamespace(lemma_names=lambda names=n: names) for n in (["entity", "Earth"], ["object"])]
    nltk = SimpleNamespace(wordnet=SimpleNamespace(all_synsets=lambda kind: iter(synsets)))
    monkeypatch.setitem(sys.modules, "nltk", SimpleNamespace(corpus=nltk))
    monkeypatch.setitem(sys.modules, "nltk.corpus", nltk)
    assert [r["lemma"] for r in pipelines.lemmas(spark, Config(project / "config.toml")).collect()] == ["entity", "object"]


def test_files_of_one_name(spark, project):
    c = Config(project / "config.toml")
    given = {"a/tei.txt": "ſa\n❧a\n", "b c/tei.txt": "ſb\n❧b\n", "tei.txt": "ſ\n"}
    for name, text in given.items():
        (project / "texts" / name).parent.mkdir(parents=True, exist_ok=True)
        (project / "texts" / name).write_text(text)
    assert pipelines.replace_characters(spark, c, str(project / "texts"), str(project / "rep")).first().asDict() == {"deleted": 2, "replaced": 3, "files": 3}
    saved = {str(p.relative_to(project / "rep/texts")): p.read_text() for p in (project / "rep/texts").rglob("*.txt")}
    assert saved == {"a/tei.txt": "sa\na\n", "b c/tei.txt": "sb\nb\n", "tei.txt": "s\n"}
    log = spark.read.json(str(project / "rep/log"))
    assert log.count() == 5 and log.select("file_path").distinct().count() == 3 and {r["file_name"] for r in log.collect()} == {"tei.txt"}
    for name in ("x", "y"):
        (project / "docs" / name).mkdir(parents=True)
        (project / "docs" / name / "d.xml").write_text(f"<TEI {NS}>\n<p>{name}\n<abbr>co$</abbr></p>\n</TEI>\n")
    assert files.xml_files(spark, str(project / "docs")).count() == 2
    pipelines.expand_documents(spark, c, str(project / "docs"), str(project / "out")).collect()
    assert all(f"<p>{name}\n<abbr" in (project / "out" / name / "d.xml").read_text() for name in ("x", "y"))


@pytest.mark.parametrize(
    "path, root, expected",
    [("file:/in/a/b%20c.xml", "/in", "a/b c.xml"), ("file:///in/a.xml", "/in/", "a.xml"), ("file:/in/a.xml", "/in/a.xml", "a.xml"), ("hdfs://n:1/in/a/b.xml", "hdfs://n:1/in", "a/b.xml"), ("file:/inner/a.xml", "/in", "inner/a.xml"), ("file:/x/in/a.xml", "/y/../x/in", "a.xml")],
)
def test_paths_below(path, root, expected):
    assert sinks.below(path, root) == expected


def test_writing_to_other_file_systems(tmp_path):
    assert sinks.write_whole("mock:///folder", "b/c.xml", "x") and not sinks.write_whole("nosuch://host/a", "b", "x")
    assert sinks.write_whole(tmp_path.as_uri(), "b/c d.xml", "ſ\r\n") and (tmp_path / "b/c d.xml").read_bytes() == "ſ\r\n".encode()
    assert sinks.write_whole(str(tmp_path), "b/e.xml", "") and (tmp_path / "b/e.xml").read_text() == ""
