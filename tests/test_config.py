import pytest

from weftwork import config


def test_defaults_and_layers(tmp_path):
    (tmp_path / "a.yaml").write_text("seed: 7\ntext: {max_terms: 100}\n")
    (tmp_path / "b.yaml").write_text("text: {min_df: 3}\n")
    s = config.load(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"))
    assert (s.seed, s.text.max_terms, s.text.min_df, s.text.overlap) == (7, 100, 3, 16)
    assert config.Settings().search.weights == {"text": 0.45, "image": 0.55}


@pytest.mark.parametrize(
    "values",
    [{"sead": 1}, {"text": {"stemmer": "other"}}, {"text": {"overlap": 128}}, {"seed": -1}, {"split_ratios": {"train": 0.5, "test": 0.4}}, {"scales": {"1k": None}}, {"search": {"weights": {"text": 2.0, "image": -1.0}}}, {"active_scale": "2k"}, {"vision": {"codebook_size": 0}}],
)
def test_refused(values):
    with pytest.raises(ValueError):
        config.from_mapping(values)
