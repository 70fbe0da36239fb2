"""gamelode.operators"""
