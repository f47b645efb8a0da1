"""Published results that the operators have to reproduce."""

# nrr, churn, contraction and expansion rates, cohort and churned customers of two months
PEAK = ("2025-11-01", 1.0612, 0.1218, 0.0142, 0.1971, 789, 188)
# June 2026: nrr and revenue churn as published with the cohort's counts
LATEST = ("2026-06-01", 0.9536, 0.1085, None, None, 1998, 516)
SHARES = {"expansion": 0.868, "contraction": 0.255, "churn": -0.124}
NAIVE = ([10.0, 20.0, 30.0], 4, [30.0] * 4)
DRIFT = ([10.0, 20.0, 30.0], 3, [40.0, 50.0, 60.0])
AMOUNTS = {"$1,234.56": 1234.56, "(500.00)": -500.0, "$99.00": 99.0, "1234.56": 1234.56, "-500.0": -500.0, " 7.5 ": 7.5, None: 0.0}
