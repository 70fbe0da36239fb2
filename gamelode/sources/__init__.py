"""gamelode.sources"""
