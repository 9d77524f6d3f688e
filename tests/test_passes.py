"""Work that queries of larger tables do once, not for every copy or pass."""

from eventloom import catalog_data

SMALL = "/root/testdata/sf0.001"


def test_leaves_are_made_once_for_their_checks_and_lists(spark):
    """Checks and lists read stored leaves; none makes the leaves again from the items."""
    x = catalog_data.rechunk_query(spark, SMALL)
    assert x.count() == 1500 and not [f for f in x.inputFiles() if "lineitem" in f or "orders" in f]


def test_copies_at_cuts_carry_only_what_regions_read(spark):
    """What a copy keeps of its event is checked before copies are made, so collections that no region reads stay out of them."""
    x = catalog_data.boundary_query(spark, SMALL)
    above, _, below = x._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert "electron" in below and "electron" not in above and "muon" not in above
