"""Rule operators: verdicts with reasons for all parcels at once."""
