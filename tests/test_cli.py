import pytest

from waymark.__main__ import main, parser
from waymark.functions.clock import bin_labels


def test_command_line(capsys):
    assert main(["list"]) == 0 and "p4_found - " in capsys.readouterr().out
    assert main(["run", "nothing", "--data", "/nowhere"]) == 2
    args = parser().parse_args(["run", "p4_found", "--data", "/x", "--out", "/y"])
    assert (args.name, args.data, args.out, args.rows) == ("p4_found", "/x", "/y", 20)


def test_bin_labels():
    assert bin_labels("day", 8, 4) == ["4:00--12:00", "12:00--20:00", "20:00--4:00"]
    assert len(bin_labels("week")) == 7 and bin_labels("mix")[20] == "Sunday evening"
    with pytest.raises(ValueError):
        bin_labels("year")
    with pytest.raises(ValueError):
        bin_labels("day", 5)
