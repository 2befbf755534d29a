"""The reports. Each takes ``Tables`` and returns one DataFrame with fixed columns."""

from almoner.plans import calls, donations, donors

REPORTS = {
    "overview": donations.overview,
    "donation_summary": donations.donation_summary,
    "monthly_donations": donations.monthly_donations,
    "monthly_trend": donations.monthly_trend,
    "daily_trend": donations.daily_trend,
    "campaign_breakdown": donations.campaign_breakdown,
    "channel_breakdown": donations.channel_breakdown,
    "donation_rows": donations.donation_rows,
    "donations_export": donations.donations_export,
    "call_summary": calls.call_summary,
    "call_outcomes": calls.call_outcomes,
    "caller_leaderboard": calls.caller_leaderboard,
    "call_rows": calls.call_rows,
    "monthly_calls": calls.monthly_calls,
    "hour_heatmap": calls.hour_heatmap,
    "calls_export": calls.calls_export,
    "donor_segments": donors.donor_segments,
    "donor_lifecycle": donors.donor_lifecycle,
    "donor_roster": donors.donor_roster,
    "at_risk_donors": donors.at_risk_donors,
}

# The smaller queries that differ from a report above.
AD_HOC = {
    "raised_totals": donations.raised_totals,
    "channel_totals": donations.channel_totals,
    "campaign_vs_goal": donations.campaign_vs_goal,
    "top_donors": donors.top_donors,
    "lapsed_by_segment_id": donors.lapsed_by_segment_id,
    "caller_totals": calls.caller_totals,
}
