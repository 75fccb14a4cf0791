"""Tables in the shared folder."""

from pathlib import Path

from veilspark.session import drop_written, shared_dir, written


def test_written_tables_are_in_the_shared_folder_and_go_when_asked(spark):
    df = written(spark.range(5), "five")
    at = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert df.count() == 5 and at.parent == Path(shared_dir(spark).removeprefix("file:")) and at.exists()
    assert drop_written(spark) >= 1 and not at.exists()
