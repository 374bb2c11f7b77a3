"""driftline.operators"""
