"""DataFrame-to-DataFrame operators for preparing, describing and scoring large event, entity and text tables."""
