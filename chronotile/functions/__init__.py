"""Column expressions: reductions over time, uncertainty, densities, quantiles, dates and periods."""
