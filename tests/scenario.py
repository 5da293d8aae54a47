"""A small hand-made scenario with hand-computed expectations."""

from rows import bill, person, read

C = 0.7480519


def season_rows(sp, acct, summer, winter):
    out = []
    for i, q in enumerate(summer):
        out.append(bill(f"{sp}-s{i}", sp, acct, "WRES", q, "2024-06-01 00:00:00", "2024-07-01 00:00:00"))
    for i, q in enumerate(winter):
        out.append(bill(f"{sp}-w{i}", sp, acct, "WRES", q, "2024-12-01 00:00:00", "2024-12-31 00:00:00"))
    return out


BILLS = (season_rows("SP1", "A1", [10, 20], [2])     # candidate, triple = 3 x 30C/60
         + season_rows("SP2", "A2", [10], [1])       # candidate without a person
         + season_rows("SP3", "A3", [1], [1])        # not a candidate
         + season_rows("SP4", "A4", [10], [1]))      # candidate, one read over the whole window

PEOPLE = [person("A1", "P1"), person("A1", "P2", phone="777"), person("A3", "P3"), person("A4", "P4"),
          person("A1", "P1", phone="DUP", ord_=1)]

READS = [
    read("SP1", "2024-06-01 22:00:00", "2024-06-02 02:00:00", 4.0),    # A sub-daily, above
    read("SP1", "2024-06-02 00:00:00", "2024-06-03 00:00:00", 1.0),    # B daily, loses to A on Jun 2
    read("SP1", "2024-06-05 00:00:00", "2024-06-06 00:00:00", 1.0),    # C
    read("SP1", "2024-06-05 00:00:00", "2024-06-06 00:00:00", 1.0),    # D = C, counted twice
    read("SP1", "2024-03-31 12:00:00", "2024-04-01 12:00:00", 2.0),    # E clipped to half, above
    read("SP1", "2024-09-30 00:00:00", "2024-10-01 00:00:00", 3.0),    # F Sep 30 = week 27, above
    read("SP1", "2024-07-01 23:59:59.5", "2024-07-02 00:00:01", 1e-9),  # H sub-second parts
    read("SP1", "2024-06-10 00:00:00", "2024-06-11 00:00:00", 9.0, uom="XX"),   # unsupported unit
    read("SP1", "2024-06-12 00:00:00", "2024-06-12 00:00:00", 9.0),    # zero length
    read("SP3", "2024-06-01 00:00:00", "2024-06-02 00:00:00", 50.0),   # not a candidate
    read("SP3", "2024-06-02 00:00:00", "2024-06-03 00:00:00", 50.0, uom=" gal ", mult=None),
    read(None, "2024-06-02 00:00:00", "2024-06-03 00:00:00", 1.0),
    read("SP4", "2024-03-01 00:00:00", "2024-11-01 00:00:00", 100.0),  # 183 covered days
]

# SP1: covered Apr 1, Jun 1, Jun 2, Jun 5, Jul 2, Sep 30; above Jun 1, Jun 2, Jun 5, Sep 30;
# reads above A, E, F. Weeks: Jun 1, Jun 2 -> 9; Jun 5 -> 10; Sep 30 -> 27 (not in the panel).
EXPECTED_METRICS = {
    "SP1": (6.0, 4.0, 3.0, {"week_09": 2.0, "week_10": 1.0}),
    "SP4": (183.0, 0.0, 0.0, {}),
}

EXPECTED_DIAGNOSTICS = {
    "candidate_sp_ids": 3, "raw_drc_rows": 13, "raw_drc_sp_ids": 3, "raw_supported_uom_rows": 12,
    "raw_supported_uom_sp_ids": 3, "prepared_drc_rows": 8, "prepared_drc_sp_ids": 2,
    "summer_overlap_drc_rows": 8, "summer_overlap_drc_sp_ids": 2,
    "summer_overlap_with_billed_threshold_sp_ids": 2,
    "summer_overlap_without_billed_threshold_sp_ids": 0, "summary_sp_ids": 2,
    "summary_sp_ids_with_any_drc_coverage": 2, "summary_sp_ids_with_drc_coverage_gt_170": 1,
}
