"""Random keys are found after names, in paths and when short; ordinary identifiers aren't."""

import random
import string

from .conftest import frame


def test_keys_glued_to_names_and_paths(spark):
    from lectern.llm.secret_scan import default_samples, secrets, train, without_secrets

    rng = random.Random(12)
    table = train(default_samples(spark))
    before = ["", "customer_account_key=", "CUSTOMER_ACCOUNT_ACCESS_KEY=", "/path/to/customer/account/file/", "AWS_SECRET_ACCESS_KEY="]
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    rows, at = [], {}
    for n in (16, 24, 32, 40):
        for b in before:
            for _ in range(40):
                at[len(rows)] = (n, b)
                rows.append((len(rows), f"see {b}{key(n)} é", "en", "a"))
    aws = "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    ordinary = "getUserAccountSettingsManager customer_account_address_list CUSTOMER_ACCOUNT_ACCESS_LEVEL /path/to/customer/account/file/name Geschwindigkeitseinstellung einlichheitenpfpfver 4425679706863800 2026-11-26T13-35 queaiaiqueeau internal-message-handler-12"
    rows += [(9000, f"x {aws} y", "en", "a"), (9001, ordinary, "en", "a")]
    found = {r.doc_id: r.spans for r in secrets(frame(spark, rows), table).collect()}
    for n, least in ((16, 0.85), (24, 0.97), (32, 1.0), (40, 1.0)):
        for b in before:
            hit = [found[k] == f"random:4:{4 + len(b) + n}" for k, v in at.items() if v == (n, b)]
            assert sum(hit) >= least * len(hit), (n, b, sum(hit))
    assert found[9000] == f"random:2:{2 + len(aws)}" and found[9001] == ""
    clean = {r.doc_id: r.text for r in without_secrets(frame(spark, rows[-2:]), table).collect()}
    assert clean == {9000: "x [SECRET] y", 9001: ordinary}
