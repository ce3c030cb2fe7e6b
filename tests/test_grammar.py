import pytest

from sigloom.functions import grammar as g


def test_values():
    assert g.values("200:1000:200") == [200, 400, 600, 800, 1000]
    assert g.values("1,5") == [1, 5] and g.values("7") == [7]
    for bad in ("1:2", "5:1:1", "1:5:0"):
        with pytest.raises(ValueError):
            g.values(bad)
    assert g.context_grid("1,2") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert g.context_grid(left="1", right="2,3") == [(1, 2), (1, 3)]
    with pytest.raises(ValueError):
        g.context_grid(left="1")


def test_metrics_and_confounds():
    assert g.metric("tpr_at_fpr:0.05") == ("tpr_at_fpr", 0.05)
    with pytest.raises(ValueError):
        g.metric("x:1")
    assert g.selection_metric("auto", 3) == "val_f1" and g.selection_metric("auto", 2) == "val_auc"
    with pytest.raises(ValueError):
        g.selection_metric("tpr_at_fpr:0.1", 3)
    assert g.confound("a:lookup:t.tsv").table == "t.tsv"
    with pytest.raises(ValueError):
        g.confound("a:lookup")
    assert g.amino_acid("tRNA-Ala-AGC-1") == "Ala"
    with pytest.raises(ValueError):
        g.amino_acid("x")


def test_windows():
    assert g.feature_window(None, 0, 5) == (-5, 0)
    assert g.kmer_slice(2, -10, 1, 5, 21) == (9, 14)
    with pytest.raises(ValueError):
        g.kmer_slice(5, -5, 1, 11, 11)
    g.exclusive(a=0, b=1)
    with pytest.raises(ValueError):
        g.exclusive(a=1, b=1)
