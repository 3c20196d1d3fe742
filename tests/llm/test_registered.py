"""The driver's contract has every corpus query while this part is there."""

import __spark_entry__ as driver


def test_every_operator_and_the_pipeline_are_registered():
    found = driver.queries()
    numbers = {int(name[2:].split("_")[0]) for name in found if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in found
    assert {"op8_licences", "op12_chat", "op13_phrases"} <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(found)
