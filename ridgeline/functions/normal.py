"""Normal and lognormal distributions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of erf and erfc by W. J. Cody (1969).
ERF_P = [3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560e00, 1.85777706184603153e-1]
ERF_Q = [2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01, 1.0]
ERFC_P = [1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8]
ERFC_Q = [1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01, 1.0]
FAR_P = [6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2]
FAR_Q = [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346047e00, 2.56852019228982242e00, 1.0]

# Algorithm AS 241, PPND16, by M. J. Wichura (1988).
MID_P = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
MID_Q = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
TAIL_P = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
TAIL_Q = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
END_P = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
END_Q = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def polynomial(x: Column, rising: list[float]) -> Column:
    out = F.lit(rising[-1])
    for c in reversed(rising[:-1]):
        out = out * x + F.lit(c)
    return out


def ratio(x: Column, p: list[float], q: list[float]) -> Column:
    return polynomial(x, p) / polynomial(x, q)


def erfc(x: Column) -> Column:
    y = F.abs(x)
    y2 = y * y
    near = 1 - x * ratio(y2, ERF_P, ERF_Q)
    mid = F.exp(-y2) * ratio(y, ERFC_P, ERFC_Q)
    inverse = 1 / F.greatest(y2, F.lit(1.0))
    far = F.exp(-y2) / F.greatest(y, F.lit(1.0)) * (1 / math.sqrt(math.pi) - inverse * ratio(inverse, FAR_P, FAR_Q))
    tail = F.when(y <= 4, mid).otherwise(far)
    return F.when(y <= 0.46875, near).when(x > 0, tail).otherwise(2 - tail)


def normal_pdf(x: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    z = (x - mean) / std
    return F.exp(-z * z / 2) / (std * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    return erfc(-(x - mean) / (std * math.sqrt(2))) / 2


def normal_quantile(p: Column) -> Column:
    """Infinite at 0 and 1, NaN outside."""
    q = p - 0.5
    mid = q * ratio(0.180625 - q * q, MID_P, MID_Q)
    r = F.sqrt(-F.ln(F.greatest(F.least(p, 1 - p), F.lit(5e-324))))
    tail = F.when(r <= 5, ratio(r - 1.6, TAIL_P, TAIL_Q)).otherwise(ratio(r - 5, END_P, END_Q))
    out = F.when(F.abs(q) <= 0.425, mid).otherwise(F.signum(q) * tail)
    return F.when((p < 0) | (p > 1), F.lit(math.nan)).when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf)).otherwise(out)


def lognormal_parameters(mean: float, variation: float) -> tuple[float, float]:
    """Mean and deviation of the logarithm from mean and coefficient of variation."""
    s2 = math.log(1 + variation * variation)
    return math.log(mean) - s2 / 2, math.sqrt(s2)


def lognormal_parameters_of(mean: Column, variation: Column) -> tuple[Column, Column]:
    """The same of columns."""
    s2 = F.ln(1 + variation * variation)
    return F.ln(mean) - s2 / 2, F.sqrt(s2)


def lognormal_pdf(x: Column, mu: float, sigma: float) -> Column:
    return F.when(x > 0, normal_pdf(F.ln(x), mu, sigma) / x).otherwise(0.0)


def lognormal_cdf(x: Column, mu: float, sigma: float) -> Column:
    return F.when(x > 0, normal_cdf(F.ln(x), mu, sigma)).otherwise(0.0)
